"""What tasks run is pickled by value: an executor needs no copy of the package."""

import os
import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from ledgerlens.llm import decontaminate, html_extract, lm_score, quality_qda, simhash_dedup, toxicity


def test_task_code_loads_without_the_package(scratch):
    lexicon = toxicity.Lexicon({"moron": 5.0}, frozenset())
    todo = [(html_extract.main_text, "<article><p>a<b>b</b></p></article>", None), (lexicon.features, "you moron"),
            (quality_qda.statistics, b"some words"), (simhash_dedup.fingerprint_of, b"a b c d", 3),
            (decontaminate.lcs, {b"a": 1, b"b": 2}, 3, [b"b"]), (lm_score.Block, [b"a b a"], np.array([True])),
            (html_extract.induce, ["<p>x</p>"]), (html_extract.loaded, "[1]")]
    path = os.path.join(scratch, "tasks")
    with open(path, "wb") as f:
        f.write(cloudpickle.dumps(todo))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = f"import pickle; [f(*a) for f, *a in pickle.load(open({path!r}, 'rb'))]; import sys; assert 'ledgerlens' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
