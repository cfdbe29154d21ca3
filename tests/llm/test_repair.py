"""Lightest repairs against a plain search over all edits, and long conversations that fill several tasks."""

import collections
import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from factwright.llm import queries, repair
from tests.llm import edge

QUERIES, _ = queries.load()
FORM = re.compile("(s?(ua)+)?")


def plain(signs):
    """Least (cost, audit) over every choice of edits with at most two insertions in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    options = [[("D", 4, "")] if s == "d" else
               [("D", 4, ""), ("K", 3 * s.isupper(), s.lower()), ("R", 3 + 3 * s.isupper(), "u"), ("R", 3 + 3 * s.isupper(), "a")] for s in signs]
    for edits in itertools.product(*options):
        for inserted in itertools.product(gaps, repeat=len(signs) + 1):
            form = inserted[0] + "".join(e[2] + g for e, g in zip(edits, inserted[1:]))
            if FORM.fullmatch(form):
                audit = "I" * len(inserted[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, inserted[1:]))
                weight = (sum(e[1] for e in edits) + 3 * audit.count("I"), audit)
                best = weight if best is None else min(best, weight)
    return best


def viterbi(signs):
    """The same weight by a row-by-row table."""
    def closed(t):
        for q, i in ((0, "u"), (1, "u"), (3, "u"), (2, "a"), (3, "u")):
            if q in t:
                to = repair.STEPS[i][q]
                t[to] = min(t.get(to, (10**9, "")), (t[q][0] + 3, t[q][1] + "I"))
        return t

    table = closed({0: (0, "")})
    for s in signs:
        new = {}
        for q, (c, a) in table.items():
            for to, more, e in repair.row_column(s)[q]:
                new[to] = min(new.get(to, (10**9, "")), (c + more, a + e))
        table = closed(new)
    return min(table[q] for q in (0, 3) if q in table)


def test_agenda_finds_the_lightest_repair_of_short_runs():
    for n in range(4):
        for signs in itertools.product("suUxd", repeat=n):
            assert repair.short("".join(signs)) == plain(signs) == viterbi(signs)


def test_spans_of_long_runs_join_to_the_same_weight():
    rng = random.Random(5)
    for n in (65, 128, 129, 700):
        signs = "".join(rng.choices("suaUAXxd", [1, 9, 9, 2, 2, 1, 1, 2], k=n))
        run = repair.Run(1)
        for k, s in enumerate(signs):
            run.add(k, s.lower() if s != "d" else "u", s, 1, 0, 0, 0)
        assert run.solve() == viterbi(signs)
        assert all(len(e) < 5 for e in run.spans().values()) and len(run.stack) <= 12


def mine(rows):
    """(gaps, faults, cost, audit, digest) of one conversation's rows after damage, worked out in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, signs, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        left = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signs.append("d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = viterbi(signs)
    writer, lines = repair.Writer(audit), []
    for _, role, text in rows:
        lines += writer.row(role, text)
    lines += writer.inserted()
    assert FORM.fullmatch("".join(r[0] for r, _ in lines)) and len(lines) == len(audit) - audit.count("D")
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def check(spark, got, damaged, ids):
    by = collections.defaultdict(list)
    for r in damaged.collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    assert {r.conv_id for r in got} == ids and len(got) == len(ids)
    for r in got:
        found = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        assert found == mine(by[r.conv_id]), r.conv_id


def test_query_agrees_with_a_plain_version(spark, tmp_path):
    path = edge.write(spark, str(tmp_path / "t"), [], conversations=edge.TURNS)
    damaged = repair.damage(spark.read.parquet(f"{path}/conversations.parquet"))
    check(spark, QUERIES["op12_lightest_repairs"](spark, path).collect(), damaged, {r[0] for r in edge.TURNS})


def test_one_conversation_fills_many_tasks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(3000)}" + rng.choice(".,")) for t in range(6000)]
    rows += [(7, 5000, "user", "often.")] * 500 + [(8, 1, "user", "a.")] + [(6, 1, "user", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = repair.runs(repair.marked(df))
        assert pieces.where("conv_id = 7").count() > 2
        check(spark, repair.repair(df, df).collect(), df, {6, 7, 8})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows_need_no_further_repair(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes!")]
    got = repair.repair(*[spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")] * 2).first()
    assert (got.cost, got.audit, got.n_repaired) == (0, "KKK", 3)
    assert got.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Yes!").hexdigest()
