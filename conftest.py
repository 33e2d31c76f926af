import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")) if x)
