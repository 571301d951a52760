import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidegauge.llm.conversation_repair import END, Suffixes, audit, digests, end_moves, repaired, repaired_blocks
from tidegauge.llm.query_conversations import damaged

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def cheapest(symbols):
    """Least (cost, edits) by trying edits from the front with a table over (row, state, insertions), no automaton."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "", ())}
    for at in range(len(symbols) + 1):
        for state in ("", "s", "u", "a", "u", "a", "u"):  # insertions reach each state again
            if (at, state) not in best:
                continue
            cost, letters, _ = best[at, state]
            offers = [((at, n), cost + 2, letters + "I") for n in follow[state] if n != "s"]
            if at < len(symbols):
                initial, fault = symbols[at]
                offers.append(((at + 1, state), cost + 3, letters + "D"))
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    if initial in follow[state] and initial:
                        offers.append(((at + 1, initial), cost + extra, letters + "K"))
                    offers += [((at + 1, n), cost + 2 + extra, letters + "R") for n in follow[state] if n != "s"]
            for place, c, s in offers:
                if place not in best or (c, s) < best[place][:2]:
                    best[place] = (c, s, ())
    return min(best[len(symbols), s][:2] for s in ("", "a") if (len(symbols), s) in best)


def brute(rows):
    found = {}
    for row in rows:
        found.setdefault(row[0], [])
    for row in brute_damage(rows):
        found[row[0]].append(row[1:])
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for turn, role, text in own:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, letters = cheapest(list(zip(initials, faults)))
        state, rest, kept = "", iter(own), []
        for letter in letters:
            if letter == "I":
                state = "assistant" if state[:1] == "u" else "user"
                kept.append(f"{state}:")
                continue
            _, role, text = next(rest)
            if letter == "D":
                continue
            state = role if letter == "K" else "assistant" if state[:1] == "u" else "user"
            kept.append(f"{state}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, digest))
    return sorted(out, key=str)


def got(df, **options):
    rows = digests(repaired_blocks(damaged(df), present="present", **options)).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
    return sorted((tuple(r) for r in rows.collect()), key=str)


def messy_rows():
    draw = random.Random(4)
    texts = ["Yes.", "No!", "and so", " \t", "", None, "what?  ", "häßlich .", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "User"]
    rows = [
        (conv, draw.choice([None, turn, turn, turn // 2]), draw.choice(roles), draw.choice(texts))
        for conv in (None, *range(40))
        for turn in range(draw.choice([1, 2, 5, 9]))
    ]
    lone = next(c for c in itertools.count(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + rows[:7] + [(lone, 0, "user", "gone.")] + [(5000, t, "user" if t % 2 else "assistant", f"t{t % 37}.") for t in range(300)]


@pytest.fixture(scope="module")
def talks(spark):
    rows = messy_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, df.withColumns({n: F.lit("x") for n in ("key", "block", "place", "here", "sig", "present", "copy")})


def test_messy_against_brute_force(talks):
    rows, df = talks
    assert got(df) == brute(rows)


def test_blocks_change_nothing(talks):
    rows, df = talks
    assert got(df, block_turns=4) == brute(rows)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == brute(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_every_short_signature_is_cheapest_and_least():
    names = {"d": ("u", "blank"), **{s: (s if s != "x" else "t", None) for s in "suax"}}
    names |= {s.upper(): (i, "truncated") for s, (i, _) in names.items() if s != "d"}
    walk = Suffixes()
    for length in range(5):
        for signature in itertools.product(names, repeat=length):
            nodes = walk.walk(END, "".join(reversed(signature)))
            letters, state = audit(nodes, 0)
            cost = nodes[-1][0][0] if nodes else END[0]
            assert (cost, letters + end_moves(state)) == cheapest([names[s] for s in signature])


def test_nodes_are_made_once_for_all_that_end_alike():
    walk = Suffixes()
    signatures = sorted("".join(p)[::-1] for n in range(1, 7) for p in itertools.product("ua", repeat=n))
    for backwards in signatures:
        walk.walk(END, backwards)
    assert walk.made == len(signatures) == 2**7 - 2


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be."), (3, 0, "tool", "x.")]
    out = repaired(repaired_blocks(spark.createDataFrame(rows, SCHEMA))).orderBy("conv", "block", "position").collect()
    assert [(r["conv"], r["edit"], r["role"], r["text"]) for r in out] == [
        (1, "K", "user", "Hi."),
        (1, "I", "assistant", ""),
        (1, "K", "user", "There."),
        (1, "K", "assistant", "Yes."),
    ]
