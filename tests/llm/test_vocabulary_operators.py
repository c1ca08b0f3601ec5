"""Piece BPE, spelling variants and conversation tries against the library, brute force and fixed cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import public_tokenizers
import tiktoken

from docstrata.llm import conversation_trie, piece_bpe, spelling

SCHEMA = "doc_id long, text string, ids string, decoded long, known string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = piece_bpe.read_ranks(public_tokenizers.path(piece_bpe.DEFAULT_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "the", "é", " ", "  ", "\n", "\t", "1", "23", "'s", "'re", "中文", "😀", "\x1c", "\x85", "　", "<|endoftext|>", "--", "…", "ß", "\x00"]


def test_piece_bpe_equals_the_library(spark, library):
    r = random.Random(5)
    texts = ["".join(r.choice([*PARTS, "x" * r.randint(1, 40)]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "ab" * 60_000, " " * 70_000, "é" * 40_000 + "x", *texts[:5]]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "same id")]
    got = piece_bpe.round_trip(frame(spark, rows))
    assert got.columns == ["doc_id", "ids", "decoded"]
    found = sorted((x.doc_id is not None, x.doc_id or 0, tuple(x.ids), bytes(x.decoded)) for x in got.collect())
    assert found == sorted((i is not None, i or 0, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    first = {x.doc_id: x for x in piece_bpe.digest(frame(spark, rows[:20])).collect()}
    for i, t in rows[:20]:
        ids = library.encode_ordinary(t)
        assert (first[i].n_tokens, first[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert first[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert piece_bpe.digest(frame(spark, [])).collect() == []
    back = piece_bpe.decode(got.drop("decoded"), bytes_col="text").collect()
    assert sorted(bytes(x.text) for x in back) == sorted((t or "").encode() for _, t in rows)


def test_piece_bpe_forgets_and_refuses(library, monkeypatch):
    own = piece_bpe.PieceBytePairs(public_tokenizers.path(piece_bpe.DEFAULT_RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(piece_bpe, "_KEPT_BYTES", 200)
    for i in range(20):
        texts = [f"word{i} and word{i + j} {'long' * 20}{i}" for j in range(20)]
        assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert own.held < 2_000
    bytes_only = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        piece_bpe.serialised_model(bytes_only | {b"ab": 300})
    with pytest.raises(ValueError):
        piece_bpe.serialised_model({b"a": 0})


def test_piece_bpe_keeps_tokens_that_merges_do_not_reach(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = piece_bpe.PieceBytePairs(str(tmp_path / "r"), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", " abc", "abc abc"):
        assert own.encode([text])[0].tolist() == known.encode_ordinary(text)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def brute_vocabulary(rows):
    counts = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def collected(found):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())


@pytest.mark.parametrize("letters,alphabet", [(160, "ab"), (900, "abcé÷"), (100_000, "abcdefgh")])
def test_spelling_variants_by_brute_force(spark, letters, alphabet):
    r = random.Random(letters)
    counts = {"".join(r.choice(alphabet) for _ in range(r.randint(5, 9))): int(3 * 2 ** r.uniform(0, 9)) for _ in range(250)}
    counts |= {"aaaa" + "".join(r.choice(alphabet) for _ in range(r.randint(1, 4))): r.randint(3, 9) for _ in range(150)}  # a hot start
    counts |= {"a" * n: 3 << min(n - 5, 20) for n in range(5, 40)}  # one chain of 34 forms
    long = "".join(r.choice(alphabet) for _ in range(3_000))
    counts |= {long: 50, long[:1500] + "z" + long[1500:]: 7, long[:-1]: 20, "z" + long[1:]: 3}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert collected(spelling.variants(vocab, range_letters=letters)) == brute_variants(counts)
    pairs = spelling.near_words(vocab, range_letters=letters).collect()
    assert sorted((p.word, p.near, p.near_n) for p in pairs) == sorted((a, b, counts[b]) for a in counts for b in counts if one_edit(a, b))


def test_spelling_of_documents(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aeßrstéÉnÀT÷") for _ in range(r.randint(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(r.choices(words, k=80))) for i in range(60)]
    rows += [(None, "Straße Straße straße 12ab_straße"), (3, None), (3, ""), (4, "\n"), (5, "stræt " * 500), (5, "stræt " * 500), (6, "x" * 50_000), (7, "x" * 50_000), (8, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "w", 1, "form") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    assert collected(spelling.document_variants(docs)) == brute_variants(brute_vocabulary(rows))
    assert collected(spelling.document_variants(docs.limit(0))) == []
    assert spelling.document_variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("aaaaa", 3)], "word string, n int"), ratio=1)


TURNS = "conv_id long, turn long, role string, text string, depth int, pos string"


def brute_trie(rows):
    """Nodes of rows (conv_id, turn, role, text), from the sequences themselves."""
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest(), said))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[c][h:]
    nodes = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes[tuple(rebuilt[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
            leaves[k[:d]] += not children[k]
    ends = {k: ",".join(str(c) for c in m if len(rebuilt[c]) == len(k)) for k, m in nodes.items()}
    return sorted(
        (m[0], len(k), -99 if not k else nodes[k[:-1]][0], len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items()
    )


def trie_rows(found):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(found.columns) == sorted(columns)
    return sorted(tuple(-99 if r[c] is None else r[c] for c in columns) for r in found.collect())


@pytest.mark.parametrize("limits", [{}, {"shard_turns": 20}, {"shard_turns": 50, "level_turns": 5}])
def test_conversation_trie_by_brute_force(spark, limits):
    r = random.Random(3)
    rows = []
    for c in range(-30, 70):
        if c % 20 or r.random() < 0.7:
            rows += [(c, r.choice([t, t, None]), r.choice(["user", None]), r.choice(["a b", "", None, "hello there\tx"])) for t in range(r.randint(1, 7))]
    for c in range(100, 130):  # a long common start, copies among the rest
        rows += [(c, t, "u", "same" if t < 15 else r.choice("xy")) for t in range(18)]
    rows += [(None, 1, "a", "b"), (500, 3, "a", "again"), (500, 3, "a", "again"), (500, 3, "b", "x " * 20_000)]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], TURNS)
    assert trie_rows(conversation_trie.trie_nodes(docs, **limits)) == brute_trie(rows)


def test_conversation_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.trie_nodes(empty).collect() == []
    silent = [(c, 0, "u", "x") for c in (1, 2, 3, 4, 5, 6) if zlib.crc32(str(c).encode()) % 4]  # no first of their family, nothing of their own
    docs = spark.createDataFrame([(*x, 1, "z") for x in silent], TURNS)
    assert trie_rows(conversation_trie.trie_nodes(docs)) == brute_trie(silent)
    same = [(c, t, "u", f"t{t}") for c in range(20, 20_000, 20) for t in range(2)]  # one text, many members
    docs = spark.createDataFrame([(*x, 1, "z") for x in same], TURNS)
    assert trie_rows(conversation_trie.trie_nodes(docs)) == brute_trie(same)


def test_double_array_walks_what_it_holds():
    r = random.Random(4)
    held = sorted({tuple(r.randint(1, 60) for _ in range(r.randint(1, 6))) for _ in range(800)} | {(k,) for k in range(1, 400)})
    trie = conversation_trie.DoubleArray([list(x) for x in held])
    beginnings = {x[:d] for x in held for d in range(1, len(x) + 1)}
    slots = {trie.walk(list(x))[-1] for x in beginnings}
    assert len(slots) == len(beginnings) == sum(c >= 0 for c in trie.check) - 1
    for _ in range(2_000):
        x = tuple(r.randint(1, 420) for _ in range(r.randint(1, 6)))
        assert len(trie.walk(list(x))) == max((d for d in range(len(x) + 1) if not d or x[:d] in beginnings))
