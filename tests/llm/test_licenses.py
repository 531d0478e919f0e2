"""License scans against plain sets and against SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

from purchaseflow.llm import licenses, queries


def brute(rows):
    sets = [(n, set(licenses.template_bigrams(t))) for n, t in licenses.TEMPLATES]
    out = {}
    for doc, text in rows:
        found, lines = [], set()
        for unit, line in enumerate([text or "", *(text or "").split("\n")]):
            own = set(licenses.template_bigrams(line))
            for name, t in sets:
                dice = 2 * len(own & t) / (len(own) + len(t)) if own else 0
                if dice >= licenses.LEAST:
                    found.append((-dice, name))
                    if unit:
                        lines.add(unit)
        best = min(found, default=(None, None))
        out[doc] = (",".join(sorted({n for _, n in found})), len(lines), best[1], None if not found else round(-best[0], 6))
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        licenses_, n, best, dice = want[r.doc_id]
        assert (r.licenses, r.n_lines, r.best) == (licenses_, n, best), r
        assert r.dice == (dice if dice is None else pytest.approx(dice, abs=1e-6))


def test_matches_plain_sets(spark):
    rng = random.Random(1)
    words = "the of and to work license under version is general public a b".split()
    rows = [(1, None), (2, ""), (3, "one"), (4, "all rights RESERVED"), (5, "Reserved rights all"), (6, "long words " * 40000)]
    for i in range(10, 160):
        name, text = rng.choice(licenses.TEMPLATES)
        parts = text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        line = " ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts)
        wrapped = rng.random() < 0.2
        lines = [line.replace(". ", ".\n", 1) if wrapped else line]
        if rng.random() < 0.7:
            lines.insert(rng.choice([0, 1]), " ".join(rng.choices(words, k=rng.choice([0, 3, 30]))))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, "All rights reserved.", 1, "x")],
                                 "doc_id long, text string, unit int, license string")
    compare(licenses.scan(docs).collect(), brute(rows))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x\nAll rights reserved."), (1, "x\nAll rights reserved."), (2, "-- \n")], "doc_id long, text string")
    compare(licenses.scan(docs).collect(), {1: ("all-rights-reserved", 1, "all-rights-reserved", 1.0), 2: ("", 0, None, None)})
    assert licenses.scan(docs.filter("false")).count() == 0


def test_only_built_in_functions(spark, sf_small):
    plan = queries.QUERIES["op7_licenses"](spark, sf_small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query_matches_sql_on_a_whole_table(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(licenses.ORACLE_SQL).fetchall()}
    assert any(w[1] for w in want.values())
    compare(queries.QUERIES["op7_licenses"](spark, sf_small).collect(), want)


def test_no_unit_reaches_the_least_without_a_marker():
    sets = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    marks = licenses.markers(sets, licenses.LEAST)
    for bigrams in sets:
        rest = [b for b in bigrams if not any(m in b for m in marks)]
        assert 2 * len(rest) / (len(rest) + len(bigrams)) < licenses.LEAST


def best_windows(text, least=licenses.LEAST):
    """Licence to Dice coefficient of its best window, stepping one word."""
    words, out = licenses.template_words(text), {}
    bigrams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, body in licenses.TEMPLATES:
        own, width = set(licenses.template_bigrams(body)), len(licenses.template_words(body)) - 1
        for at in range(len(bigrams) - width + 1):
            window = set(bigrams[at:at + width])
            dice = 2 * len(window & own) / (len(window) + len(own))
            if dice >= least:
                out[name] = max(dice, out.get(name, 0))
    return out


def test_notices_inside_longer_texts(spark):
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(300)] + "the of and to a is in copy work version software any".split()
    rows = []
    for i, (name, text) in enumerate(licenses.TEMPLATES * 4):
        parts = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            parts[rng.randrange(len(parts))] = rng.choice(filler)
        before, after = (rng.choices(filler, k=rng.choice([0, 3, 200])) for _ in "ab")
        if i % 2:  # wrapped every few words
            k = rng.choice([4, 7])
            parts = [w + "\n" * (n % k == k - 1) for n, w in enumerate(parts)]
        rows.append((i, " ".join([*before, *parts, *after])))
    rows += [(900, " ".join(t for _, t in licenses.TEMPLATES)), (901, "All rights reserved. " * 300), (902, "w " * 400 + "All rights\nreserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in licenses.matches(docs).filter("unit = -1").collect():
        got.setdefault(r.doc_id, {})
        got[r.doc_id][r.license] = max(r.dice, got[r.doc_id].get(r.license, 0))
    want = {d: w for d, t in rows if (w := best_windows(t))}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d] == pytest.approx(w), d
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    units = brute(rows)
    for d, t in rows:
        named, n_lines, best, dice = units[d]
        alone = [(-v, n) for n, v in want.get(d, {}).items() if n not in named.split(",")]
        least, name = min([*alone, *([(-dice, best)] if best else [])], default=(None, None))
        assert found[d].licenses == ",".join(sorted({*named.split(","), *want.get(d, {})} - {""}))
        assert (found[d].n_lines, found[d].best) == (n_lines, name)
        assert found[d].dice == (None if name is None else pytest.approx(-least, abs=2e-6))


@pytest.mark.parametrize("name, text", [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) > 10 and not n.startswith("cc-")])
def test_a_wrapped_notice_and_one_in_a_paragraph_are_found(spark, name, text):
    around = " ".join(f"w{i}" for i in range(200))
    wrapped = "\n".join(" ".join(text.split()[i:i + 4]) for i in range(0, len(text.split()), 4))
    docs = spark.createDataFrame([(1, f"{around}\n{wrapped}\n{around}"), (2, f"{around} {text} {around}"), (3, around)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.best, r.dice) for r in licenses.scan(docs).collect()}
    assert got == {1: (name, name, 1.0), 2: (name, name, 1.0), 3: ("", None, None)}


def test_sql_finds_the_same_windows(spark):
    rng = random.Random(5)
    filler = [f"w{i}" for i in range(300)] + "the of and to a is in copy work version software any".split()
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES * 2):
        parts = [w + "\n" * (n % 5 == 4) for n, w in enumerate(text.split())]
        for _ in range(rng.choice([0, 1, 2])):
            parts[rng.randrange(len(parts))] = rng.choice(filler)
        rows.append((i, " ".join([*rng.choices(filler, k=rng.choice([0, 3, 90])), *parts, *rng.choices(filler, k=60)])))
    rows += [(900, " ".join(t for _, t in licenses.TEMPLATES)), (902, "w " * 400 + "All rights\nreserved"), (903, None), (904, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(licenses.ORACLE_SQL).fetchall()}
    assert sum(1 for w in want.values() if w[0] and not w[1]) > 10  # by windows only
    compare(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)
