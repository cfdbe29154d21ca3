"""Small tables with every odd case, and plain versions of what the operators compute."""

import collections
import math
import re
import zlib

WORD = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PROSE = ("The quick brown fox jumps over the lazy dog while seventeen grey herons watch from a wall of old stones near the river "
         "and nobody asks why the boats have left before noon or who has taken the oars and rope that hung beside the door all "
         "through the winter when snow lay deep on roofs and fields alike until the thaw came late in March that year")
LONG = " ".join(f"w{i * i % 7919} of{i % 13}" for i in range(150_000))  # over two blocks
ODD = [
    (1, PROSE, "en", "src0", 1), (2, PROSE, "en", "src0", 2), (2, PROSE, "en", "src0", 2), (3, None, None, None, None), (4, "", "en", None, 0),
    (5, " \n\t ", "en", "src1", 4), (6, "Short", "en", "src1", 5), (7, LONG, "en", "src2", 6), (8, "x" * 1_500_000, "de", "src2", 7),
    (9, PROSE.replace("March", "April"), "en", "src1", 8), (10, PROSE.replace("a wall", "one Wall") + " é ▁ \n\n end", "fr", "Src1", 9),
    (11, "123 456 !!", None, "", 3), (12, "one two", "de", "src0", 2), (13, "ONE  two", "de", "src0", 2), (14, "\n".join(["same line here"] * 30), "en", "é", 3),
    (None, PROSE, "en", "src0", 1), (None, "lone text without an id", None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: One row of each id, as SQL that groups by ids needs it.
PLAIN = [r for i, r in enumerate(ODD) if r[0] is not None and r[0] not in [x[0] for x in ODD[:i]]]


#: Turns that are null, repeated, missing and far apart, roles and texts that are null or odd, and a conversation longer than several leaves.
TURNS = [
    *[(c, t, ("system", "user", "assistant")[(t > 0) + (t > 0 and t % 2 == 0)], f"Line {t} of {c}" + ("." if t % 3 else " …")) for c in range(40) for t in range(c % 7)],
    (100, None, "user", "When?"), (100, None, None, None), (100, 1, "assistant", ""), (100, 5, "tool", "x."), (100, 5, "user", "x."), (100, 9, "assistant", "é!\u00a0 "),
    (101, None, None, None), (102, 3, "USER", "Hi."), (102, 4, "umpire", "Out!"), (102, 5, "assistant", "Ok. \n\t"), (-3, -7, "user", "a."), (-3, -5, "assistant", "b?"),
    (None, 0, "user", "no id."), (None, 1, "assistant", "none."), (None, 1, "assistant", "none."), (103, 1, "user", "y" * 200_000),
    *[(104, t, ("user", "assistant")[t * t % 5 % 2], f"{t % 17}" + ".,"[t % 4 == 0]) for t in range(400)], *[(105, 1, "user", "same.")] * 300,
]
VECTORS = [
    *[(i, [math.sin(i * k) / (1 + k % 3) for k in range(1, 9)], i % 3) for i in range(260)], *[(1000 + i, [0.25] * 8, i % 2) for i in range(120)],
    (2000, None, 1), (2100, [0.5] * 8, None), (2200, [None] + [0.5] * 7, 1), (2300, [math.nan] * 8, 1), (2400, [math.inf] + [0.5] * 7, 1), (None, [0.25] * 8, 1), (None, [0.3] * 8, 0),
    (2500, [0.0] * 8, 2), (2600, [-0.1] * 8, 0), (2600, [-0.1] * 8, 0), (200, [0.25] * 8, 1), (2700, [-1e-20] * 8, 1), (2800, [900.0] * 8, 5), (-700, [0.2, -0.2] * 4, -3),
]


def write(spark, path, docs=ODD, labels=(), benchmark=(), pages=(), conversations=(), embeddings=()):
    """A folder of tables, with columns that clash with names inside the operators."""
    extra = ", row string, key long, size long, shard int, copy int, `_size` int"
    more = ("r", 7, 8, 9, 10, 11)
    spark.createDataFrame([(*r, *more) for r in docs], SCHEMA + extra).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    more = ", `role2` string, kind int, digest string, copy int, spans string, key long, v string, score long"
    spark.createDataFrame([(*r, "u", 1, "d", 2, "s") for r in conversations], "conv_id long, turn long, role string, text string" + more[: more.index(", key")]).repartition(3).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(*r, 4, "v", 6) for r in embeddings], "vec_id long, embedding array<float>, label int" + more[more.index(", key") :]).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def words(text, fold=True):
    text = text or ""
    return re.findall(WORD, text.translate(LOW) if fold else text)


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(rows, k, percent):
    """Least id of each row's group."""
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return out


def base_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    tokens = [[*words(r[1]), None] for r in rows]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(r[0], h, len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for r, h, t in zip(rows, held, tokens)]
