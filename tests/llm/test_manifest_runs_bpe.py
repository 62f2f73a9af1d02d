"""BPE against the tokenizers library, periodic runs and the Merkle manifest against brute force, each with edge cases, through the operators and the queries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark.llm import bpe, merkle, periodic, queries
from recallspark.llm.common import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["body", "g", "at", "task", "pos", "total", "digest", "changed", "block", "items", "floors", "node", "top", "above", "j", "x", "leaf", "subroot", "root", "runs", "start", "ids", "decoded"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n) for i, t, lang, source, n in rows], SCHEMA).repartition(3)


def write(spark, rows, path):
    table(spark, rows).write.parquet(str(path / "documents.parquet"))
    return str(path)


def same(spark, rows, f):
    """Rows of f, which extra columns of any name don't change."""
    plain = table(spark, rows)
    more = plain
    for k, c in enumerate(NAMES):
        more = more.withColumn(c, F.lit(k))
    got = sorted(map(str, f(plain).collect()))
    assert got == sorted(map(str, f(more).collect()))
    return got


# --- BPE


@pytest.fixture(scope="module")
def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def encoder(path):
    return bpe.Encoder(bpe.Vocabulary(path))


LETTERS = ["abcde", "aeiourstln ", "aaab", "'stremvd llABC ", " \t\n\x0b\x1c\x85 　x\x00", "ÉéüßİıſΣσς ", "漢字かな한국어 ", "é́̈ ao", "0123²½٣ ", "😀👍🏽 ♥️", "!?.,;:<|>/w"]


def texts(library, rng, n):
    tokens = [x.replace("</w>", " ") for x in library.get_vocab()]
    for k in range(n):
        if k % 4 == 0:
            yield "".join(rng.choice(rng.choice(LETTERS)) for _ in range(rng.randrange(40)))
        elif k % 4 == 1:
            one = rng.choice(LETTERS)
            yield "".join(rng.choice(one) for _ in range(rng.randrange(60)))
        elif k % 4 == 2:
            yield "".join(rng.choice(tokens) for _ in range(rng.randrange(12)))
        else:
            yield "".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "ab", "Zoë ", "<|", "|>", "'s", " "]) for _ in range(rng.randrange(9)))


def test_bpe_equals_the_library(library, encoder):
    rng = random.Random(1)
    some = [*texts(library, rng, 2000), "a" * 30000, "ab" * 20000, "é" * 9999, "<|endoftext|>" * 500, " " * 50000, "x" + "́" * 3000]
    for t, found in zip(some, encoder.encode([t.encode() for t in some]), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert [int(i) for i in found.split()] == ids
        assert encoder.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_bpe_does_not_depend_on_what_was_kept(library, path, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STRETCHES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    encoder = bpe.Encoder(bpe.Vocabulary(path))
    for t in texts(library, random.Random(2), 200):
        assert [int(i) for i in encoder.encode([t.encode()])[0].split()] == library.encode(t, add_special_tokens=False).ids


def test_tokens_that_end_at_each_prefix(encoder):
    """The automaton's matches are all tokens that are suffixes of what was read."""
    v = encoder.vocabulary
    rng = random.Random(3)
    letters = bpe.byte_letters()
    known = {v.text[i] for i in v.ids}
    for _ in range(200):
        word = bytes(rng.choice(b"abehinorstu") for _ in range(rng.randrange(1, 14)))
        state = read = 0
        for i, c in enumerate(word, 1):
            while (to := v.steps.get(state << 9 | c)) is None:
                state = v.automaton.link[state]
                read = v.automaton.size[state]
            state, read = to, read + 1
            found = {v.text[t] for t, n in v.tokens[state] if n <= read}
            seen = "".join(letters[b] for b in word[:i])
            assert found == {seen[k:] for k in range(i)} & known


def test_bpe_query(spark, library, tmp_path):
    rng = random.Random(4)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts(library, rng, 60))] + [(70, None, None, None, None), (71, "", "en", "s", 0), (None, "a b", "en", "s", 0), (3, "again", "en", "s", 0), (3, "again", "en", "s", 0)]
    got = sorted(map(tuple, queries.op11_bpe(spark, write(spark, rows, tmp_path)).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


def test_bpe_of_malformed_text_and_extra_columns(spark, library, path):
    d = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62C3' AS STRING) AS text")
    assert bpe.encode(d, path).first()["ids"] == library.encode(b"a\xffb\xc3".decode("utf-8", "replace"), add_special_tokens=False).ids
    assert bpe.digest(table(spark, []), path).count() == 0
    assert len(same(spark, [(1, "Hello, World", "en", "s", 0), (None, None, None, None, None)], lambda x: bpe.digest(x, path))) == 2


# --- periodic runs


def brute_runs(s, least):
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                w = s[i : i + size]
                if not any(all(w[x] == w[x + p] for x in range(size - p)) for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for k in range(1500):
        n, a = rng.randrange(1, 60), rng.choice([1, 2, 2, 3, 4, 8])
        s = [rng.randrange(a) for _ in range(n)]
        if k % 3 == 0:
            s = ([rng.randrange(3) for _ in range(rng.randrange(1, 9))] * 60)[:n]
            for _ in range(rng.randrange(3)):
                s[rng.randrange(n)] = rng.randrange(4)
        if k % 7 == 0:
            f, g = [0], [0, 1]
            while len(g) < n:
                f, g = g, g + f
            s = g[:n]
        assert sorted(periodic.runs(np.array(s)), key=lambda r: (r[0], r[2])) == brute_runs(s, 2), s


def squares(s):
    return {tuple(s[i : i + 2 * k]) for k in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * k + 1) if s[i : i + k] == s[i + k : i + 2 * k]}


def test_vocabulary_has_each_tandem_repeat_once():
    """Marks of the suffix tree are the kinds of tandem repeats, and each start of a mark is one."""
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(1, 3) for _ in range(rng.randrange(2, 50))]
        found = periodic.vocabulary(periodic.SuffixTree(np.array([*s, 0])))
        kinds = [tuple(s[i : i + 2 * k]) for k, nodes in found.items() for i in nodes.values()]
        assert len(kinds) == len(set(kinds)) and set(kinds) == squares(s)


def test_stretches_of_texts_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        lists = []
        for _ in range(rng.randrange(1, 6)):
            n, a = rng.randrange(0, 120), rng.choice([1, 2, 3, 30])
            w = [b"w%d" % rng.randrange(a) for _ in range(n)]
            if n and rng.random() < 0.7:
                i, p = rng.randrange(n), rng.randrange(1, 25)
                w[i:] = [w[min(i + (j - i) % p, n - 1)] for j in range(i, n)]
            lists.append(w)
        monkeypatch.setattr(periodic, "STRING", rng.choice([10, 50, 1 << 16]))
        words = Words(pa.array([b" ".join(w) for w in lists], pa.large_binary()), fold=False)
        assert periodic.find(lists, words) == [brute_runs(w, 12) for w in lists]


def test_long_periodic_strings():
    n = 100_000
    assert periodic.runs(np.zeros(n, int)) == [(0, n, 1)]
    assert periodic.runs(np.arange(n) % 777) == [(0, n, 777)]


def test_runs_query(spark, tmp_path):
    """The whole contract, word by word."""
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(90))), "en", "s", 0) for i in range(150)]
    rows += [(200, None, None, None, None), (201, " \n", "en", "s", 0), (202, "x " * 40, "en", "s", 0), (None, "y z " * 9, "en", "s", 0), (202, "x " * 40, "en", "s", 0), (203, "É é " * 8 + "É", "en", "s", 0)]
    want = []
    for d, t, *_ in rows:
        w = (t or "").split()
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w, 12)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((d, len(found), *figures, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, write(spark, rows, tmp_path)).collect()), key=repr)
    assert got == sorted(want, key=repr) and sum(x[1] > 0 for x in want) > 8


def test_runs_of_malformed_text_and_extra_columns(spark):
    d = spark.sql("SELECT 1L AS doc_id, CAST(unhex(repeat('FF20', 20)) AS STRING) AS text")
    r = periodic.detect(d).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 20, 1)] and r["collapsed"] == "�"
    assert periodic.detect(table(spark, [])).count() == 0
    assert len(same(spark, [(1, "a b " * 20, "en", "s", 0), (None, None, None, None, None)], periodic.detect)) == 2


# --- Merkle manifest


def brute_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, w in enumerate(where):
                a = w - w % 16
                paths[i].append(("".join(nodes[a:w]), "".join(nodes[w + 1 : a + 16])))
                where[i] = w // 16
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    sources = {}
    for d, text, lang, source, n in rows:
        sources.setdefault(source, []).append((d, source, lang, n, text))
    trees = []
    for s in sorted(sources, key=lambda x: (x is not None, (x or "").encode())):
        rs = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((rs, *tree([leaf(r) for r in rs])))
    if not trees:
        return []
    root, above = tree([t[1] for t in trees])
    out = []
    for (rs, top, paths), more in zip(trees, above, strict=True):
        for r, p in zip(rs, paths, strict=True):
            node = leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in p + more:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), top, root, sha("".join(a + b for a, b in p + more)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "sources", "paths"), [(0, 1, 9), (1, 1, 9), (17, 1, 9), (300, 3, 0), (4500, 270, 0)])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, n, sources, paths):
    """Trees of up to four levels, more sources than a block holds, nulls everywhere, repeated rows and ids; joins by broadcast and by shuffle."""
    monkeypatch.setattr(merkle, "PATHS", paths)
    rng = random.Random(n)
    rows = [(i if rng.random() < 0.98 else None, rng.choice([None, "", "aé b", "A b", "x Y"]), rng.choice(["en", None]), rng.choice([None, *[f"s{k}" for k in range(sources)]]) if rng.random() < 0.4 else "s0", rng.choice([3, None])) for i in range(n)]
    rows += rows[:1] * 3
    got = [tuple(r) for r in queries.op13_merkle(spark, write(spark, rows, tmp_path)).collect()]
    assert sorted(got, key=repr) == brute_manifest(rows)


def test_manifest_with_extra_columns_and_malformed_text(spark):
    assert len(same(spark, [(1, "A", "en", "s", 0), (None, None, None, None, None), (1, "A", "en", "s", 0)], merkle.manifest)) == 3
    d = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF' AS STRING) AS text, 'en' AS lang, 's' AS source, 2L AS n_chars")
    r = merkle.manifest(d, F.lit(True)).first()
    assert r["leaf"] == sha(b"1:11:s2:en1:22:a\xff") == r["subroot"] == r["root"]
