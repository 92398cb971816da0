"""Model calls in tasks, and the HTTP model against a small server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from trovelight.functions.calls import Policy, Resource, ask_all
from trovelight.functions.models import HttpModel, ModelError
from trovelight.operators.lexical import LexicalIndex
from trovelight.plans.retriever import Retriever

FAST = Policy(tries=3, wait=0.01)


def model_that_loads_once(folder):
    """Leaves a file for each time that it is made; fails questions with `bad` always and those with `shaky` twice."""

    def make():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        class Model:
            def __init__(self):
                self.tries = {}

            def available(self):
                return True

            def complete(self, system, messages):
                text = messages[-1]["content"]
                self.tries[text] = self.tries.get(text, 0) + 1
                if "bad" in text or ("shaky" in text and self.tries[text] < 3):
                    raise ValueError("no answer")
                return f"{system} {text}"

        return Model()

    return make


def test_calls_run_in_tasks_with_one_load_a_worker(spark, tmp_path):
    rows = [(i, ["fine", "bad", "shaky", None][i % 4]) for i in range(200)]
    asked = spark.createDataFrame(rows, "qid long, text string").repartition(8)
    got = {r["qid"]: r for r in ask_all(asked, Resource(model_that_loads_once(str(tmp_path))), "S", "q: ", FAST).collect()}
    assert len(got) == 200
    assert got[0]["text"] == "S q: fine" and got[0]["tries"] == 1 and got[3]["text"] == "S q: "
    assert got[1]["text"] is None and got[1]["error"] == "ValueError: no answer" and got[1]["tries"] == 3
    assert got[2]["error"] is None
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert made and len(made) == len(set(made))


def test_a_model_that_cannot_be_made_fails_its_questions(spark):
    def make():
        raise OSError("no weights")

    asked = spark.createDataFrame([("a", "x")], "qid string, text string")
    assert [tuple(r) for r in ask_all(asked, Resource(make), "", "", FAST).collect()] == [("a", None, "OSError: no weights", 3)]
    assert ask_all(asked.limit(0), Resource(make), "", "", FAST).count() == 0


def test_failed_questions_are_told_and_the_others_answered(spark, tmp_path):
    texts = ["red brick tower", "bread at dawn", "a lamp", "bad weather"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from trovelight.functions.models import embed

    chunks = embed(docs).selectExpr("id as ord", "cast(id as string) id", "'s' source", "text", "vector").cache()
    found = Retriever(chunks, LexicalIndex.build(chunks, "id", "text"), model=Resource(model_that_loads_once(str(tmp_path))), policy=FAST)
    asked = spark.createDataFrame([(1, "brick"), (2, "bad weather")], "qid long, text string")
    hyde = found.hyde(asked, 2)
    assert {r["qid"] for r in hyde.collect()} == {1}
    both = found.multi_query(asked, 1)
    assert {(r["qid"], r["id"]) for r in both.collect()} == {(1, "0"), (2, "3")}
    assert [[r["qid"] for r in f.collect()] for f in found.failures] == [[2], [2]]


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if body["model"] == "none":
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            parts = ["An ", "", "éxact ", body["messages"][-1]["content"]]
            if body["stream"]:
                data = "".join(json.dumps({"message": {"content": p}}, ensure_ascii=False) + "\n" for p in parts) + '{"message": {"content": "lost"}}'
                for i in range(0, len(data.encode()), 7):
                    self.wfile.write(data.encode()[i : i + 7])
                    self.wfile.flush()
            else:
                self.wfile.write(json.dumps({"message": {"content": "".join(parts)}}).encode())

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_http_model(server):
    said = [{"role": "user", "content": "end"}]
    model = HttpModel(server, "some")
    assert model.available() and model.complete("s", said) == "An éxact end"
    assert list(model.stream("s", said)) == ["An ", "éxact ", "end"]
    with pytest.raises(ModelError, match="404.*none"):
        HttpModel(server, "none").complete("s", said)
    gone = HttpModel("http://127.0.0.1:9")
    assert not gone.available()
    with pytest.raises(ModelError, match="reached"):
        list(gone.stream("s", said))
