"""Operators 11 to 13 against plain versions, with their edge cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from contentlens.llm import filter_audit, spelling, vector_links
from tests.conftest import SMOKE

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

# op11 ---------------------------------------------------------------------------------------


def plain_measures(text):
    words, data = SPACE_WORD.findall(text.encode()), text
    return [len(words), len(set(words)), len(re.findall("[A-Z]", data)), len(data), len(re.findall(r"[#$%&*|]", data))]


def test_transducer_measures_any_text():
    rng = random.Random(5)
    texts = ["", " ", "\t\n", "A", "é　é", "𝔘é▁ <b>#</b>", "\0a \0a a\0", "x" * 700 + " " + "x" * 700 + " " + "x" * 699 + "y",
             "abcdefgh abcdefgh\0 abcdefghi abcdefghi", "a\x0bb\x1cc\x85d\xa0e", "p" * 20 + " " + "p" * 9 + "q" + "p" * 10]
    texts += ["".join(rng.choice("aAb #\n\té▁𝔘") for _ in range(rng.randrange(400))) for _ in range(200)]
    got = filter_audit.measure([t.encode() for t in texts])
    assert [list(r) for r in got] == [plain_measures(t) for t in texts]


def test_equal_hashes_of_unlike_words_are_told_apart():
    texts = [b"one two one three " + b"z" * 40 + b" " + b"z" * 39 + b"y", b"one two", b"w" * 300 + b" " + b"w" * 300 + b" " + b"w" * 299 + b"v"]
    buffer = b" ".join(texts) + b" " * 9
    spans = [m.span() for m in SPACE_WORD.finditer(buffer)]
    start, end = (np.array(x) for x in zip(*spans))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    words = filter_audit.Words(buffer, start, end, owner)
    for hashes in (np.zeros(len(start), np.uint64), None):
        first = filter_audit.first_of_each(words, hashes)
        assert np.bincount(owner[first]).tolist() == [5, 2, 2]


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        w, d, c, n, s = plain_measures(t or "")
        bad = [w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, i is not None and i > least[t or ""]]
        fails.append((i, part or "", {x for x, b in zip("ABCDE", bad) if b}))
    out, shapley = {}, collections.Counter()
    for part in {p for _, p, _ in fails}:
        of = [(i, f) for i, p, f in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            before = set()
            for step, x in enumerate(order, 1):
                here = [i for i, f in of if x in f and not f & before]
                shapley[part, x] += len(here)
                out[part, "".join(order), step] = [
                    sum(not f & (before | {x}) for _, f in of), len(here), sum(x in f and bool(f & before) for _, f in of),
                    sum(f == {x} for _, f in of), sum(i in good for i in here), sum(i in toxic for i in here)]
                before.add(x)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_counts_every_order(spark):
    rng = random.Random(2)
    some = [" ".join(rng.choice(["Ab", "cde", "#x", "yy", "word%d" % rng.randrange(300)]) for _ in range(rng.randrange(1, 500))) for _ in range(12)]
    rows = [(i, rng.choice([*some, None, "", " ", "plain " * 250]), rng.choice(["en", "de", "", None])) for i in range(120)]
    rows += [(None, some[0], "en"), (None, some[0], "fr"), (7, some[1], "en"), (7, some[1], "en"), (7, some[2], "de"), (500, " ".join(f"w{i}" for i in range(400)), "en")]
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 100)] + [(7, 1, None), (8, 5, 5), (None, 1, 1), (9, None, None)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labelled).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * len({r.part for r in got})
    assert filter_audit.audit(docs.limit(0), labelled).collect() == []
    assert sum(r.kept for r in filter_audit.audit(docs, labelled.limit(0)).collect()) == sum(r.kept for r in got)


# op12 ---------------------------------------------------------------------------------------

def plain_links(rows, least=0.95):
    ok = {}
    for k, (_, x) in enumerate(rows):
        if x and all(e is not None and math.isfinite(e) for e in x) and any(x):
            v = np.array(x) / np.abs(x).max()
            ok[k] = v / np.sqrt((v * v).sum())
    near = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k]) and float(ok[j] @ ok[k]) >= least] for k in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo += [j for j in near.get(todo.pop(), []) if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((i, len(near.get(k, [])), low, i == low))
    return sorted(out, key=repr)


def vector_rows(n=260, size=6):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, size))
    rows = [(i, (centre[rng.integers(40)] * rng.uniform(0.5, 2) + rng.normal(size=size) * 0.12).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]                                            # copies
    rows += [(1100 + i, (centre[0] + rng.normal(size=size) * 0.05).tolist()) for i in range(90)]   # a large group of near copies
    rows += [(2000, [e * 1e200 for e in rows[7][1]]), (2001, [e * 1e-200 for e in rows[7][1]]), (2002, [-0.0] + rows[8][1][1:]), (2003, [0.0] + rows[8][1][1:])]
    rows += [(2100, None), (2101, []), (2102, [0.0] * size), (2103, [math.nan] + [1.0] * (size - 1)), (2104, [None] + [1.0] * (size - 1)),
             (2105, [math.inf] * size), (2106, [1.0, 2.0]), (2107, [2.0, 4.1]), (None, rows[9][1]), (None, [1.0, -9.0]), (3, rows[3][1]), (3, rows[30][1])]
    return rows


@pytest.mark.parametrize("cell, block", [(8192, 8192), (20, 8192), (20, 7), (400, 16)])
def test_every_link_is_found_once(spark, cell, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, x double, node int").repartition(5)
    got = vector_links.near_duplicates(df, cell=cell, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == plain_links(rows)
    if cell == 20 and block == 7:
        assert vector_links.near_duplicates(df.limit(0)).collect() == []


def test_bounds_keep_distant_cells_apart(spark):
    rng = np.random.default_rng(1)
    centre = np.eye(8)
    data = [(i, (centre[i % 8] + rng.normal(size=8) * 0.03).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, x, 1, 8) for i, x in data], "node long, x array<double>, copies long, size int")
    pivots = vector_links.choose_pivots(df, math.acos(0.95), 10)
    vector_links.cell_spans(df, pivots)
    placed = vector_links.members(df, pivots)
    homes = {r["node"]: r["cell"] for r in placed.filter("NOT replica").collect()}
    assert len(homes) == 400
    replicas = placed.filter("replica").collect()
    # copies go only to cells of pivots about the same centre: a fifth at most of all cells
    assert len(replicas) < 400 * len(set(homes.values())) / 5
    u = {i: np.array(x) / np.linalg.norm(x) for i, x in data}
    sent = {(r["node"], r["cell"]) for r in replicas}
    for a, b in itertools.combinations(u, 2):
        if u[a] @ u[b] >= 0.95 and homes[a] != homes[b]:
            assert ((a, homes[b]) in sent) != ((b, homes[a]) in sent)


# op13 ---------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_variants(rows, least_length=7, every=31):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    near, drop = {w: set() for w in count}, collections.defaultdict(set)
    for w in count:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            drop[x].add(w)
    for met in drop.values():
        for a, b in itertools.combinations(met, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


def test_search_schemes_find_all_words_one_edit_apart():
    rng = random.Random(4)
    for letters, sizes, n in (("ab", (7, 8, 9), 400), ("abcé", (7, 8, 12), 600), ("a", range(7, 40), 30)):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice(list(sizes)))).encode("latin-1") for _ in range(n)})
        queries = words + [b"ababababab", b"zzzzzzzz", b"\xff" * 300]
        found = [(queries[a], words[b]) for left in (True, False) for q, w in spelling.near_words(queries, words, left)
                 for a, b in zip(q.tolist(), w.tolist())]
        want = {(a, b) for a in queries for b in words if one_edit(a, b)}
        assert len(found) == len(set(found)) and set(found) == want


def test_large_intervals_are_looked_at_by_symbol(monkeypatch):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(8)).encode() for _ in range(500)})
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    monkeypatch.setattr(spelling, "FEW", 3)
    monkeypatch.setattr(spelling, "STATES", 5)
    got = [(words[a], words[b]) for left in (True, False) for q, w in spelling.near_words(words, words, left) for a, b in zip(q.tolist(), w.tolist())]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [40_000, 9])
def test_variants_of_messy_texts(spark, block):
    rng = random.Random(8)
    base = ["Straßenbahn", "straßenbahn", "ÉCOLES", "éCoLeS", "example", "examples", "exemple", "exampel", "sentence", "sentances", "sentence",
            "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "short", "x×y÷zzzz", "naïveté"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(40)) + " example" * 30) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\t"), (None, "examples examples naïveté"), (53, "w" * 3000 + " " + "w" * 3000 + "-" + "w" * 2999), (3, rows[3][1]), (3, rows[3][1]),
             (54, "abcdefgh " * 1000 + "abcdefgx " * 90 + "abcdefgxy " * 8 + "abcdefxy " * 8), (55, "1example2example_example'example")]
    docs = spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.spelling_variants(docs, block=block).collect()
    assert len(got) == len({r.word for r in got}) and set(map(tuple, got)) == plain_variants(rows)
    if block == 9:
        assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_variants_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_spelling_variants"](spark, SMOKE).collect()
    assert set(map(tuple, got)) == plain_variants(rows)
