from collections import Counter, defaultdict

import pytest

from tidegauge.llm import line_dedup
from tidegauge.llm.line_dedup import drop_site_lines


def brute(rows, ratio, least):
    pages, counts = Counter(), defaultdict(Counter)
    for host, text in rows:
        if host is not None:
            pages[host] += 1
            counts[host].update({line.strip(" ") for line in (text or "").split("\n")} - {""})
    gone = {h: {x for x, n in c.items() if n >= least and n > ratio * pages[h]} for h, c in counts.items()}
    return [
        None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone.get(h, ())) for h, t in rows
    ]


def run(spark, rows, ratio, least):
    df = spark.createDataFrame([(i, h, t, "x", 1) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, host string, boilerplate_lines int")
    out = drop_site_lines(df.repartition(3), ratio=ratio, min_pages=least, dropped="lost")
    assert out.columns == [*df.columns, "lost"]
    return {r["doc_id"]: r for r in out.collect()}


@pytest.mark.parametrize("bound", [0, 200_000])
def test_lines_against_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_MARKS", bound)
    rows = [("a", f"menu\nown {i}\n\n menu \nfooter") for i in range(8)]
    rows += [("a", "menu"), ("a", ""), ("a", None), ("a", "own 1\nown 1"), ("b", "menu\nfooter"), ("b", "plain")]
    rows += [(None, "menu\nfooter")] * 6 + [("c", "x\n" * 5000 + "menu")] * 2
    for ratio, least in ((0.1, 2), (0.5, 5), (0.9, 1)):
        got, want = run(spark, rows, ratio, least), brute(rows, ratio, least)
        for i, (_, text) in enumerate(rows):
            assert got[i]["text"] == want[i]
            assert got[i]["lost"] == (None if text is None else len(text.split("\n")) - len_lines(text, want[i]))


def len_lines(text, clean):
    # A text that lost every line is empty without being one blank line.
    return 0 if clean == "" and "" not in [x.strip(" ") for x in text.split("\n")] else len(clean.split("\n"))


def test_messy_rows_keep_their_columns(messy, messy_rows, nothing):
    out = drop_site_lines(messy)
    assert out.schema == messy.schema and out.count() == len(messy_rows)
    assert drop_site_lines(nothing).collect() == []
