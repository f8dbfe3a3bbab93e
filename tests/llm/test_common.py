import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quarryline.llm.common import ascii_lower, materialise, release, shared_folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("text", ["", "ABC xyz", "École ÉCOLE", "İstanbul I", "ẞß ΣΑΣ ǅ Ⅷ Ⓐ", "日本 A", "a\x00B", "Ä" * 5000 + "Z"])
def test_only_ascii_letters_are_lowered(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(ascii_lower(F.col("t")).alias("t")).first().t == text.translate(LOWER)


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(ascii_lower(F.col("t")).alias("t")).first().t is None


def test_tables_are_written_and_released(spark):
    df = materialise(spark.range(10).withColumn("x", F.rand()), "numbers")
    assert df.collect() == df.collect() and shared_folder(spark) in df.inputFiles()[0]
    assert release(spark) >= 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.count()


# In a JVM of its own, as what others have left in this one would be counted too.
FREED = r"""
import gc, re, time
from pathlib import Path

from quarryline.llm.common import materialise, trim_driver
from quarryline.session import local_session

spark = local_session("2", memory="1g")
jvm = spark._jvm
smaps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps")


def held():
    # MB in high addresses, where the heap is not.
    found = re.findall(r"^(?:([0-9a-f]+)-[0-9a-f]+ |Anonymous:\s+(\d+))", smaps.read_text(), re.M)
    return sum(int(kb) for (at, _), (_, kb) in zip(found[::2], found[1::2], strict=True) if int(at, 16) >> 40) / 1024


able = smaps.exists() and trim_driver(spark)
if able:
    # Many small native buffers, of which the last stays, so that malloc keeps the memory of the others.
    made = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(3000)]
    last = made.pop()
    del made
    gc.collect()
    jvm.System.gc()
    time.sleep(2)
    kept = held()
    materialise(spark.range(1), "one")
    print("MB", round(kept - held()))
print("able" if able else "unable")
"""


def test_memory_that_the_driver_frees_outside_its_heap_goes_back():
    out = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, timeout=120).stdout
    if "unable" in out:
        pytest.skip("a JVM without this command")
    assert int(re.search(r"MB (-?\d+)", out)[1]) > 100
