import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_conftest import edge, nothing, workers_find_the_package  # noqa: E402, F401
