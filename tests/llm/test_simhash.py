import random

import numpy as np
import pytest
import xxhash

from tidegauge.llm.simhash_vp import (
    PARTS,
    block_masks,
    fingerprint,
    fingerprints,
    links,
    near_groups,
    near_pairs,
    similar_groups,
    similarity_radius,
)


def plain(text, shingle):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_wide(text, shingle):
    """The parts side by side in one integer, all from one hash of each shingle."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes, out, low = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs], 0, (1 << 64) - 1
    for part in range(PARTS):
        mixed = []
        for h in hashes:
            if part:
                h = (h + part * 0x9E3779B97F4A7C15) & low
                h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & low
                h = ((h ^ h >> 27) * 0x94D049BB133111EB) & low
                h ^= h >> 31
            mixed.append(h)
        out |= sum(1 << 64 * part + b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed))
    return out


def groups(marks, radius):
    """Least id reachable, over all pairs."""
    left, out = set(range(len(marks))), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            x = todo.pop()
            own.append(x)
            near = {y for y in left if (marks[x][1] ^ marks[y][1]).bit_count() <= radius}
            left -= near
            todo += near
        ids = [marks[x][0] for x in own if marks[x][0] is not None]
        for x in own:
            out[x] = min(ids, default=None)
    return sorted(((*marks[i], out[i]) for i in out), key=str)


def brute(rows, shingle, radius):
    return groups([(i, plain(t, shingle)) for i, t in rows], radius)


def got(df, **how):
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in near_groups(df, **how).collect()), key=str)


def test_messy(messy, messy_rows):
    rows = [(r[0], r[1]) for r in messy_rows]
    assert got(messy) == brute(rows, 4, 4)
    assert got(messy, shingle=5, radius=6) == brute(rows, 5, 6)


def test_given_documents(small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert got(small) == brute(rows, 4, 4)


def similar(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in similar_groups(df).collect()), key=str)


def test_similar_messy(messy, messy_rows):
    assert similar(messy) == sorted(brute_resemblance([(r[0], r[1]) for r in messy_rows]), key=str)


def test_similar_given_documents(small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert similar(small) == sorted(brute_resemblance(rows), key=str)


def test_similar_finds_resemblance_of_four_fifths(spark, monkeypatch):
    """Of pairs with a resemblance of 0.8 to 0.95, nine in ten are found; of pairs of 0.6 and of others, none."""
    monkeypatch.setattr("tidegauge.llm.simhash_vp.SHARD_POINTS", 16)
    rng, rows, alike = random.Random(4), [], {}
    for base in range(0, 800, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        aim = rng.choice([0.6, 0.8, 0.85, 0.9, 0.95])
        runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        resemblance = lambda: len(runs(words) & runs(other)) / len(runs(words) | runs(other))
        while True:
            at = rng.randrange(300)
            before, other[at] = other[at], f"x{rng.randrange(10**6)}"
            if resemblance() < aim:
                other[at] = before
                break
        rows += [(base, " ".join(words)), (base + 1, " ".join(other))]
        alike[base + 1] = resemblance()
    found = dict(similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert all(c in (i, i & ~1) for i, c in found.items())
    high = [found[i] == i - 1 for i, r in alike.items() if r >= 0.8]
    assert len(high) > 200 and sum(high) >= 0.9 * len(high)
    assert not any(found[i] == i - 1 for i, r in alike.items() if r < 0.65)


def test_nothing(nothing):
    assert near_groups(nothing).collect() == []
    assert similar_groups(nothing).collect() == []


@pytest.mark.parametrize(("radius", "equal"), [(4, 1), (6, 1), (4, 2), (0, 1)])
def test_links_join_what_all_pairs_join(spark, radius, equal, monkeypatch):
    """Chains of near values, a ball of many near copies and unrelated values, over deep trees."""
    monkeypatch.setattr("tidegauge.llm.simhash_vp.SHARD_POINTS", 8)
    rng = np.random.default_rng(radius * 10 + equal)
    values = set(rng.integers(0, 2**63, 300).tolist())
    for start in rng.integers(0, 2**63, 20).tolist():
        for _ in range(12):
            for bit in rng.choice(64, 3, replace=False).tolist():
                start ^= 1 << bit
            values.add(start)
    hub = int(rng.integers(0, 2**63))
    values |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {0, 1, 2**64 - 1}
    values = sorted(values)
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long").repartition(4)
    edges = [(a % 2**64, b % 2**64) for a, b in links(df, radius, equal).collect()]
    assert len(edges) <= len(values) * len(block_masks(radius, equal))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    mine, want = {}, {}
    for v, _, c in groups([(v, v) for v in values], radius):
        want.setdefault(c, set()).add(v)
        mine.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_a_branch_is_left_out_only_beyond_the_radius():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 2**16, 3000).astype(np.uint64))
    pairs = {p for i, j in near_pairs(points[:, None], 2) for p in zip(i.tolist(), j.tolist())}
    far = np.bitwise_count(points[:, None] ^ points[None, :])
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(far <= 2)) if i < j}


def test_long_text_in_parts(spark):
    text = " ".join(f"w{i % 70_001}" for i in range(140_000))
    assert fingerprint(text.encode(), 4) == plain(text, 4)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert fingerprints(df).first()["fp"] % 2**64 == plain(text, 4)


def shingle_set(text, shingle=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def brute_resemblance(rows, similarity=0.8):
    """Least id reachable over all pairs of this resemblance, by the sets themselves."""
    sets = [shingle_set(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= similarity
    while left:
        todo, own = [left.pop()], []
        while todo:
            x = todo.pop()
            own.append(x)
            near = {y for y in left if alike(sets[x], sets[y])}
            left -= near
            todo += near
        ids = [rows[x][0] for x in own if rows[x][0] is not None]
        for x in own:
            out[x] = min(ids, default=None)
    return sorted(((rows[i][0], out[i]) for i in out), key=str)


def test_similar_is_resemblance_of_shingles(spark, messy, messy_rows, small, monkeypatch):
    """Pairs just below 0.8 stay apart and pairs just above are joined, whatever their fingerprints say."""
    monkeypatch.setattr("tidegauge.llm.simhash_vp.SHARD_POINTS", 16)
    assert similar(messy) == brute_resemblance([(r[0], r[1]) for r in messy_rows])
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert similar(small) == brute_resemblance(rows)
    rng, rows = random.Random(5), []
    for base in range(0, 1200, 3):  # of 296 shingles a run of n new words at the end changes n: 0.8 is up to 32
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for number, n in enumerate((0, rng.randrange(20, 33), rng.randrange(33, 60))):
            rows.append((base + number, " ".join([*words[: 300 - n], *(f"x{rng.randrange(10**6)}" for _ in range(n))])))
    got = dict(similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    want = {}
    for at in range(0, len(rows), 3):
        want.update(brute_resemblance(rows[at : at + 3]))
    assert sum(want[i] != i for i in want) >= 400
    lost = [i for i in want if got[i] != want[i]]
    assert not [i for i in got if got[i] not in (want[i], i)]  # no false link
    assert len(lost) <= 0.01 * 400
