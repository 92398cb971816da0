import os
import sys

for folder in (os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))):
    if folder not in sys.path:
        sys.path.insert(0, folder)
