"""Files in the older layout, written from a stream of rows and read by ranges of their points."""

import struct

from pyspark.sql import functions as F

from tesselon.plans import samples
from tesselon.sources import codec


def test_old_files_are_written_and_read_by_ranges(spark, tmp_path):
    q = [(f"f{k % 3}.bin", (k * 7919) % 65536, (k * 31) % 65536, k % 65536) for k in range(2500)]
    rows = spark.createDataFrame(q, "file string, qx long, qy long, qz long")
    rows = rows.select("file", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("low"), F.array(*[F.lit(65535.0)] * 3).alias("high"), "qx", "qy", "qz")
    samples.write_old_tiles(rows, str(tmp_path))
    (tmp_path / "none.bin").write_bytes(b"none of them")
    # a count beyond the bytes, and one that leaves some unread
    (tmp_path / "long.bin").write_bytes(codec.OLD_MAGIC + struct.pack("<6I", 1, 0, 99, 0, 0, 0) + struct.pack("<6f", 0, 0, 0, 65535, 65535, 65535) + struct.pack("<6H", 1, 2, 3, 4, 5, 6))
    (tmp_path / "short.bin").write_bytes(codec.OLD_MAGIC + struct.pack("<6I", 1, 0, 1, 0, 0, 0) + struct.pack("<6f", 0, 0, 0, 65535, 65535, 65535) + struct.pack("<6H", 1, 2, 3, 4, 5, 6))
    want = sorted([(f, float(x), float(y), float(z)) for f, x, y, z in q] + [("long.bin", 1.0, 2.0, 3.0), ("long.bin", 4.0, 5.0, 6.0), ("short.bin", 1.0, 2.0, 3.0)])
    name = F.element_at(F.split("path", "/"), -1)
    whole = codec.read_old(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select(name, F.inline("points")).collect())) == want
    for split in (100, codec.OLD_SPLIT):
        assert sorted(map(tuple, codec.read_old_points(spark, str(tmp_path), split=split).select(name, "x", "y", "z").collect())) == want
