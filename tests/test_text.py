import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelight.functions import text
from trovelight.functions.models import overlap_logit, stream_content
from trovelight.operators.chunking import chunk_text

PAGE = """<!DOCTYPE html>
<html><head><title>Harbour Tower</title><style>p { margin: 0; }</style><script>log("hidden");</script></head>
<body><nav>Home &middot; Visit</nav><h1>The Tower</h1><p>It was built in <b>1901</b> &amp; the
keeper&#39;s house&#8212;stands.</p><br class=x><br/>z</body></html>"""


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_html(spark):
    got = one(spark, PAGE, text.html_to_text)
    assert "hidden" not in got and "margin" not in got
    assert "It was built in 1901 & the\nkeeper's house—stands." in got
    assert one(spark, "a&amp;#39;b &amp;lt; <br class=x>z &#x27; </p >q", text.html_to_text) == "a'b &lt; z &#x27; q"
    assert one(spark, "&#128512; &#55357;", text.html_to_text) == "😀 �"
    assert one(spark, "&#9999999;", text.html_to_text) is None
    assert one(spark, None, text.html_to_text) is None


def test_trim_knows_wide_spaces(spark):
    assert one(spark, "﻿  a b　\n", text.trim) == "a b"


def chunks_model(t, most=1500, overlap=200):
    """The rule in plain steps, for comparison."""
    import re

    out, cur, size = [], "", 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", t)):
        if not p:
            continue
        if len(p) > most:
            if size:
                out.append(cur)
            pieces = [p[i : i + most] for i in range(0, len(p), most - overlap)]
            out += pieces
            cur = pieces[-1][-overlap:]
            size = len(cur)
        elif size and size + len(p) > most:
            out.append(cur)
            tail = cur[-overlap:]
            cur, size = tail + "\n\n" + p, len(tail) + len(p) + 2
        else:
            cur, size = (cur + "\n\n" + p) if size else p, size + len(p) + 2
    return out + ([cur] if size else [])


@pytest.mark.parametrize(
    ("sizes", "want"),
    [([1500], [1500]), ([1501], [1500, 201, 200]), ([1600], [1500, 300, 200]), ([2700], [1500, 1400, 100, 100]), ([2900], [1500, 1500, 300, 200]), ([1300, 300], [1300, 502]), ([1000, 1000, 1000], [1000, 1202, 1202]), ([1600, 1400], [1500, 300, 200, 1602])],
)
def test_chunk_lengths(spark, sizes, want):
    got = one(spark, "\n\n".join("x" * n for n in sizes), chunk_text)
    assert [len(c) for c in got] == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 70), st.sampled_from(["\n\n", "\n \n", "\n", " "])), max_size=12))
def test_chunks_equal_the_model(spark, parts):
    t = "".join("abcdefg"[i % 7] * n + sep for i, (n, sep) in enumerate(parts))
    assert one(spark, t, lambda c: chunk_text(c, 40, 7)) == chunks_model(t, 40, 7)


def test_chunk_arguments():
    for overlap in (0, 1500):
        with pytest.raises(ValueError):
            chunk_text(None, 1500, overlap)


def test_small_functions(spark):
    assert one(spark, "1. first\n\n- second\n3) 4th\nx", lambda c: text.variant_lines(c, 3)) == ["first", "second", "th"]
    assert one(spark, "A [2]. B [1][2] [9] [1, 3] [0]", lambda c: text.citations(c, F.lit(3))) == [1, 2]
    assert one(spark, "Café a b2 XY", text.tokenize) == ["caf", "b2", "xy"]
    assert one(spark, "abcde", text.estimate_tokens) == 2
    assert one(spark, "the tower", lambda c: overlap_logit(c, F.lit("tower"))) == 0.0
    assert one(spark, '{"message":{"content":"a"}}\n\n{"message":{"content":"b"}}\n{"message":{"content":"c"}}', stream_content) == "ab"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in rows.select(text.normalize(F.col("v"))).collect()]
    assert got[0] == [0.6, 0.8] and all(x != x for x in got[1])


def test_long_texts_are_chunked_in_blocks(spark):
    parts = ["p" * (i * 37 % 400) + str(i) for i in range(1000)] + ["q" * 4000, "r" * 1500, "s" * 1501]
    text = "\n\n".join(parts)
    got = spark.createDataFrame([(text,)], "text string").select(chunk_text(F.col("text"))).first()[0]
    assert got == chunks_model(text, 1500, 200)
    tight = spark.createDataFrame([(text,)], "text string").select(chunk_text(F.col("text"), 500, 300)).first()[0]
    assert tight == chunks_model(text, 500, 300)
