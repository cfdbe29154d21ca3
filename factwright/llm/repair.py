"""Repair of the structure of conversations by lightest derivations.

A conversation's rows, in order, are edited so that the initials of their roles read ``(s?(ua)+)?``. What is searched is a weighted
hypergraph: an item (k, q) says that the first k columns have been used and that the initials given so far leave the automaton in
state q. A column is one row, or a run of rows whose own lightest derivations are known; (k, q) and an edge q -> r of column k derive
(k + 1, r), and an insertion derives (k, r) from (k, q). Every deduction adds its cost and appends its edits, so that its weight
(cost, audit) is never below that of its antecedents, and ``lightest`` may pop items from an agenda by weight and finalise each at its
first pop, until the goals are popped.

Each conversation takes as many tasks as it fills. Rows, without texts, are dealt by ranges of (conversation, turn, role, digest); a
task walks its sorted rows and writes each run of a conversation as a string of signs, cut into leaves of ``LEAF`` rows. Conversations
within a task are solved there. Of a run that touches a task's border only its table of spans (from each state to each) goes on, and
the few tables of a conversation are columns of one more derivation. Then texts and audits are dealt by conversation, sorted by the same
order and streamed, with constant memory but for one audit: the digest of one repaired text is sequential by definition.

Defined cases: null roles and texts are one space, as are null ids and turns where they are spelled out; a null conv_id is a
conversation of its own and a null turn comes first; rows of one turn are ordered by role and SHA-256 of the text, so that equal ones are
neighbours; a role's initial is its first character, and one that isn't s, u or a can't be kept; an empty table gives no rows."""

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factwright.session import cut

LEAF = 64
SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where each initial leads from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GOALS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 3), ("D", 4), ("I", 3)
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated", "illegal")


def lightest(columns: list, start: int, goals=(START, SYSTEM, USER, ASSISTANT), insert: bool = True, first: bool = False) -> dict:
    """Lightest (cost, audit) of the items (len(columns), q), q in ``goals``, from (0, start). A column gives edges
    (to, cost, edits) by state. With ``first`` the agenda ends at the first goal popped."""
    agenda, done, found = [(0, "", 0, start)], set(), {}
    while agenda and len(found) < len(goals):
        cost, audit, k, q = heapq.heappop(agenda)
        if (k, q) in done:
            continue
        done.add((k, q))
        if k == len(columns):
            if q in goals:
                found[q] = (cost, audit)
                if first:
                    break
        else:
            for to, more, edits in columns[k].get(q, ()):
                if (k + 1, to) not in done:
                    heapq.heappush(agenda, (cost + more, audit + edits, k + 1, to))
        if insert:
            for initial in "ua":
                to = STEPS[initial].get(q)
                if to is not None and (k, to) not in done:
                    heapq.heappush(agenda, (cost + INSERT[1], audit + INSERT[0], k, to))
    return found


@lru_cache(None)
def row_column(sign: str) -> dict:
    """Edges of one row by its sign: d has to go; else its initial (x for any other), upper case if its text is truncated."""
    out = {}
    for q in range(4):
        edges = [(q, DELETE[1], DELETE[0])]
        if sign != "d":
            more = TRUNCATED if sign.isupper() else 0
            to = STEPS.get(sign.lower(), {}).get(q)
            if to is not None:
                edges.append((to, KEEP[1] + more, KEEP[0]))
            edges += [(STEPS[i][q], REROLE[1] + more, REROLE[0]) for i in "ua" if q in STEPS[i]]
        out[q] = edges
    return out


@lru_cache(1 << 14)
def leaf(signs: str) -> dict:
    """The spans of a run of rows: edges as of a column."""
    columns = [row_column(s) for s in signs]
    return {q: [(to, *w) for to, w in lightest(columns, q).items()] for q in range(4)}


def join_spans(spans: list) -> dict:
    return {q: [(to, *w) for to, w in lightest(spans, q, insert=False).items()] for q in range(4)}


@lru_cache(1 << 14)
def short(signs: str) -> tuple[int, str]:
    return next(iter(lightest([row_column(s) for s in signs], START, GOALS, first=True).values()))


class Run:
    """The rows of one conversation in one task: counts, and the spans of what has been read, joined like the digits of a binary
    counter so that a run of n rows costs n log n."""

    def __init__(self, conv):
        self.conv, self.stack, self.signs = conv, [], ""
        self.counts = dict.fromkeys(FAULTS, 0)
        self.rows = 0
        self.head = self.tail = None  # first and last initial
        self.turns = [0, None, None]  # distinct ones, first and last; nulls aside

    def add(self, turn, initial, signs, initials, blank, duplicate, truncated):
        if self.tail is not None and self.tail + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.counts["illegal"] += initials - 1
        self.counts["blank"] += blank
        self.counts["duplicate"] += duplicate
        self.counts["truncated"] += truncated
        self.head = initial if self.head is None else self.head
        self.tail = initial
        self.rows += initials
        if turn is not None and turn != self.turns[2]:
            self.turns = [self.turns[0] + 1, turn if self.turns[1] is None else self.turns[1], turn]
        self.signs += signs
        while len(self.signs) > LEAF:
            self.push(leaf(self.signs[:LEAF]), 1)
            self.signs = self.signs[LEAF:]

    def push(self, spans, size):
        while self.stack and self.stack[-1][1] <= size:
            before, n = self.stack.pop()
            spans, size = join_spans([before, spans]), n + size
        self.stack.append((spans, size))

    def columns(self) -> list:
        return [s for s, _ in self.stack] + ([leaf(self.signs)] if self.signs else [])

    def solve(self) -> tuple[int, str]:
        if not self.stack:
            return short(self.signs)
        return next(iter(lightest(self.columns(), START, GOALS, insert=False, first=True).values()))

    def spans(self) -> dict:
        return join_spans(self.columns())


_SPAN = "array<struct<q:int,to:int,cost:long,edits:string>>"
_STATS = ", ".join(f"{c} long" for c in FAULTS)
_RUN = f"part int, at int, head string, tail string, distinct long, low long, high long, {_STATS}, cost long, audit string, spans {_SPAN}"
_SPAN_TYPE = pa.list_(pa.struct([("q", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def _flat(spans: dict) -> list:
    return [{"q": q, "to": to, "cost": c, "edits": e} for q, edges in spans.items() for to, c, e in edges]


def _nested(flat) -> dict:
    out: dict = {q: [] for q in range(4)}
    for s in flat:
        out[s["q"]].append((s["to"], s["cost"], s["edits"]))
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with every twentieth row each dropped, emptied, cut short, repeated and given the
    role user."""
    blank = F.lit(" ")
    one = F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)
    kind = F.crc32(F.concat_ws(":", *one)) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    ).where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def marked(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text: the number of equal rows, the initial, whether it is blank, cut short, or has an
    equal row in an earlier turn."""
    left = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (left == "").alias("blank"),
        (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut"))
    keys = ("conv_id", "turn", "role", "digest", "blank", "cut")
    each = cut(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    # a null turn is the first one
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    twice = each.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("begun"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = twice.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("begun.turn").alias("begun"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    # r is null where a row has no equal in another turn
    later = F.col("r").isNotNull() & ~F.col("turn").eqNullSafe(F.col("begun"))
    return each.join(twice, same, "left").select(*keys, "copies", later.alias("later"))


def runs(found: DataFrame) -> DataFrame:
    """Per conversation and task: counts, and the lightest derivation, or the spans where the run touches the task's border."""
    kind = found.schema["conv_id"].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    dealt = found.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "digest", "blank", "cut", "copies", "later")
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "digest")

    def run(batches):
        from pyspark import TaskContext

        part, at, one, out, id_type, first = TaskContext.get().partitionId(), 0, None, [], None, True

        def close(border):
            spans = _flat(one.spans()) if border else None
            cost, audit = (None, None) if border else one.solve()
            out.append((one.conv, part, at, one.head, one.tail, *one.turns, *one.counts.values(), cost, audit, spans))

        def batch_of():
            kinds = [id_type, pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * (4 + len(FAULTS)), pa.string(), _SPAN_TYPE]
            names = ["conv_id", *[f.split(" ")[0] for f in _RUN.split(", ")]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv, turn, initial, blank, short_text, copies, later in zip(*(c.to_pylist() for c in batch.columns)):
                if one is None or conv != one.conv:
                    if one is not None:
                        close(first)
                        first, at = False, at + 1
                    one = Run(conv)
                own = initial if initial in STEPS else "x"
                sign = "d" if blank or later else own.upper() if short_text else own
                truncated = not blank and not later and short_text
                # of equal rows of a turn the first may stay, the others are duplicates
                full, rest = divmod(copies - 1, LEAF)
                one.add(turn, own, sign, 1, int(blank), int(later and not blank), int(truncated))
                if copies > 1:
                    for n in [LEAF] * full + [rest] * (rest > 0):
                        one.add(turn, own, "d" * n, n, n if blank else 0, 0 if blank else n, 0)
            if len(out) >= 2_000:
                yield batch_of()
                out.clear()
        if one is not None:
            close(True)
            yield batch_of()

    return dealt.mapInArrow(run, f"conv_id {kind}, {_RUN}")


def solve(found: DataFrame) -> DataFrame:
    """Per conversation with rows: gaps, counts of faults, cost and audit."""
    kind = found.schema["conv_id"].dataType.simpleString()
    ready = cut(runs(found))
    gaps = lambda low, high, n: F.coalesce(F.col(high) - F.col(low) + 1 - F.col(n), F.lit(0))
    columns = ("conv_id", "gaps", *FAULTS, "cost", "audit")
    inner = ready.where("spans IS NULL").withColumn("gaps", gaps("low", "high", "distinct")).select(*columns)
    # at most two runs a task touch its borders
    border = ready.where("spans IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ready.columns if c not in ("conv_id", "cost", "audit")]))).alias("runs"))

    def run(batches):
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("runs").to_pylist()):
                cost, audit = next(iter(lightest([_nested(p["spans"]) for p in parts], START, GOALS, insert=False, first=True).values()))
                counts = [sum(p[c] for p in parts) for c in FAULTS]
                counts[3] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
                timed = [p for p in parts if p["low"] is not None]
                n = sum(p["distinct"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
                gap = timed[-1]["high"] - timed[0]["low"] + 1 - n if timed else 0
                out.append((conv, gap, *counts, cost, audit))
            if out:
                kinds = [batch.column("conv_id").type, *[pa.int64()] * 6, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(columns))

    over = border.mapInArrow(run, f"conv_id {kind}, gaps long, {_STATS}, cost long, audit string")
    return inner.unionByName(over)


class Writer:
    """Walks an audit beside the rows that it edits and gives the lines of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _put(self, initial: str):
        self.state = STEPS[initial][self.state]

    def _role(self) -> str:
        return "a" if self.state == USER else "u"

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == INSERT[0]:
            initial = self._role()
            self._put(initial)
            self.at += 1
            yield ROLES[initial], ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP[0]:
            self._put(role[0])
            yield role, text
        elif edit == REROLE[0]:
            initial = self._role()
            self._put(initial)
            yield ROLES[initial], text


def repaired(rows: DataFrame, solved: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations``: what ``solved`` says, the number of repaired rows and the SHA-256 of their lines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    stats = ("gaps", *FAULTS, "cost")
    empty = [F.lit(None).cast("long").alias(c) for c in stats]
    named = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("kind"), *empty, F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))])
    known = solved.select("conv_id", F.lit(1).alias("kind"), *stats, "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))])
    texts = rows.select("conv_id", F.lit(2).alias("kind"), *empty, F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    digest = F.when(F.col("kind") == 2, F.unhex(F.sha2("text", 256)))
    dealt = named.unionByName(known).unionByName(texts).withColumn("digest", digest).repartition("conv_id")
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]).drop("digest")

    def run(batches):
        names = ["conv_id", *stats, "audit", "n_repaired", "repaired_sha256"]
        held, hashed, writer, lines, out, id_type, begun = None, None, None, 0, [], None, False

        def put(pairs):
            nonlocal lines
            for role, text in pairs:
                hashed.update((("\n" if lines else "") + role + ":" + text).encode())
                lines += 1

        def close():
            put(writer.inserted())
            out.append((*held, lines, hashed.hexdigest()))

        def batch_of():
            kinds = [id_type, *[pa.int64()] * len(stats), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv, sort, *values, audit, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", *stats, "audit", "turn", "role", "text"))):
                if sort == 0:
                    if begun:
                        close()
                    held, hashed, writer, lines, begun = (conv, *[0] * len(stats), ""), hashlib.sha256(), Writer(""), 0, True
                elif sort == 1:
                    held, writer = (conv, *values, audit), Writer(audit)
                else:
                    put(writer.row(role, text))
            if len(out) >= 2_000:
                yield batch_of()
                out.clear()
        if begun:
            close()
            yield batch_of()

    return dealt.mapInArrow(run, f"conv_id {kind}, gaps long, {_STATS}, cost long, audit string, n_repaired long, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The repair of ``rows`` (conv_id, turn, role, text; no nulls in the last two), for every conversation of ``conversations``."""
    return repaired(rows, solve(marked(rows)), conversations)
