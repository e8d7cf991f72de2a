"""What a worker keeps between jobs."""

import subprocess
import sys

HELD = """
import re, numpy as np, pyarrow as pa
from foliospark.llm.texts import pieces
mb = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
before = [np.ones(100_000, np.uint8) for _ in range(3000)]
last = np.ones(100_000, np.uint8)              # nothing below it goes back by itself
del before
held = mb()
list(pieces(pa.record_batch({"text": ["one text"]})))
print(held - mb())
"""


def test_memory_of_an_earlier_job_goes_back_before_the_next_texts():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True)
    assert int(done.stdout) > 200
