import zlib
from collections import defaultdict

from tidegauge.llm.byte_shards import byte_shards


def brute(rows, shards):
    """Rows in order of (id, size, checksum); a row goes where the middle of its bytes falls."""
    sized = sorted(
        ((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    total, before, out, slots = sum(s for _, s, _ in sized), 0, [], defaultdict(int)
    for (known, i), size, crc in sized:
        shard = min(shards - 1, (before + size // 2) * shards // total)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def compare(df, rows, shards):
    got = sorted(map(tuple, byte_shards(df, shards).collect()), key=str)
    assert got == brute(rows, shards)
    return got


def test_messy(messy, messy_rows):
    for shards in (1, 3, 40):
        compare(messy, [(r[0], r[1]) for r in messy_rows], shards)


def test_real_rows_are_balanced(small):
    got = compare(small, [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()], 10)
    sizes = defaultdict(int)
    for _, size, _, shard, _ in got:
        sizes[shard] += size
    largest = max(size for _, size, *_ in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_one_id_fills_the_table(spark):
    df = spark.createDataFrame([(7, "same")] * 500, "doc_id long, text string").repartition(5)
    compare(df, [(7, "same")] * 500, 4)


def test_nothing(nothing):
    assert byte_shards(nothing, 4).collect() == []


def test_no_python_on_the_path(small):
    plan = byte_shards(small, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
