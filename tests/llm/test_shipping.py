"""Every function that goes to a worker must come out of its pickle where this package cannot be imported."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from seqcast.llm import convtrie, decontam, langid, lm, neardup, negatives, packing, quality, substrings, tokenfiles, warc
from seqcast.session import ship_package

BOOKS = (np.zeros((2, 1)), np.zeros((2, 1)))
FUNCTIONS = {
    "op1 sketches": lambda: neardup._sketched(5, 85).func,
    "op1 sets": lambda: neardup._sets(5).func,
    "op1 pivots": lambda: neardup._with_pivots(85),
    "op1 blocks": lambda: neardup._compared(85),
    "op2 sample": lambda: langid._sampled,
    "op2 judge": lambda: langid._predicted(langid.Model(np.zeros((0, 256 + langid.HASHED), np.float32), [])).func,
    "op3 phrases": lambda: substrings._phrase_rows(13, 6),
    "op3 windows": lambda: substrings._window_rows(13),
    "op3 parse": lambda: substrings._parsed(13, True).func,
    "op4 ids": lambda: tokenfiles._tokenized("x", 2),
    "op5 code": lambda: lm._coded(lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 0)),
    "op5 train": lambda: lm._trained(2, lm.Network(2).flat(), 1.0),
    "op7 count": lambda: decontam._counted([decontam.Index([("1", "a b c")], 10)]),
    "op10 pack": lambda: packing._packer("x", 1, 2048, pa.int64()),
    "op11 positives": lambda: negatives._searching(BOOKS, negatives._positives(5), ["a"]),
    "op11 negatives": lambda: negatives._searching(BOOKS, negatives._negatives(10, 30, 90), ["a"]),
    "op12 sweep": lambda: convtrie._sweep,
    "op12 trunks": lambda: convtrie._trunks,
    "op12 forks": lambda: convtrie._common().func,
}


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_functions_leave_the_package_behind(name, tmp_path):
    ship_package()
    (tmp_path / "f.pickle").write_bytes(cloudpickle.dumps(FUNCTIONS[name]()))
    code = f"import pickle, sys; sys.path[:] = [p for p in sys.path if p]; f = pickle.load(open({str(tmp_path / 'f.pickle')!r}, 'rb')); assert callable(f); assert 'seqcast' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
