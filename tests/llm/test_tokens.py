"""Operators on public tokenizers, against the libraries themselves and plain re-tellings."""

import base64
import hashlib
import random
from collections import Counter

import pytest

from lexloom.llm.byte_bpe import PATTERN, VOCABULARY, PerfectHash, Vocabulary, read_ranks, shared_vocabulary, decoder, token_digests, tokenised
from lexloom.llm.token_alignment import BYTE_LEVEL, PIECES, ByteLevel, Pieces, align, alignment_scores
from tests.llm.helpers import LONG, awkward, frame

ODD = ["naïve  café\t\n\n 3.14 it's WE'LL don't", "a" * 700, "日本語の文章、テスト。", "😀😃 x y　z\x1c\x85", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁bars", " leading", "trailing  ", "   ", "\n", "\x00nul\x00", "ß" * 50 + " of the of the", "ﬁ ligature Å Å", "é ‍﻿"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def random_texts(n, seed=3):
    r = random.Random(seed)
    words = ["the", "of", "tion", "Zqx", "é", "naïve", "12", "3.5", "--", "…", "日本", "it's", "\n", "  ", "\t", "😀", "abcabcabc", "<s>", "x" * 40]
    return [r.choice(["", " "]) + "".join(r.choice(words) + r.choice([" ", " ", " ", "", "  "]) for _ in range(r.randrange(1, 60))) for _ in range(n)]


class TestByteBpe:
    def test_the_hash_is_minimal_and_perfect(self):
        for n in (0, 1, 2, 5, 300, 5000):
            keys = [f"key{i}".encode() for i in range(n)]
            h = PerfectHash(keys)
            assert sorted(h.place.tolist()) == list(range(n))
            assert not n or (h.slots(keys) == h.place).all()
            assert not n or ((0 <= h.slots([b"other", b""])) & (h.slots([b"other", b""]) < n)).all()

    def test_merging_equals_a_plain_search_for_the_least_pair(self):
        tokens = read_ranks(VOCABULARY)
        v = Vocabulary(tokens, PerfectHash(tokens))
        r = random.Random(1)

        def plain(piece):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                pairs = [(v.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in v.ranks]
                if not pairs:
                    return [v.ranks[p] for p in parts]
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        for _ in range(2000):
            piece = bytes(r.choice(b"aab ethonrs\xc3\xa9\xff") for _ in range(r.randrange(1, 30)))
            assert v.merged(piece) == plain(piece)

    def test_equals_the_library_and_round_trips(self, spark, library):
        texts = [*ODD, *random_texts(300), LONG]
        got = {r.doc_id: r for r in tokenised(frame(spark, list(enumerate(texts)))).collect()}
        for i, t in enumerate(texts):
            assert got[i].ids == library(t), repr(t[:50])
            assert got[i].decoded == t.encode()

    def test_whole_table(self, spark, library):
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        got = sorted(map(tuple, token_digests(docs).collect()))
        ids = [(r.doc_id, r.text or "", library(r.text or "")) for r in docs.collect()]
        assert got == sorted((d, len(i), sha(" ".join(map(str, i))), sha(t)) for d, t, i in ids)

    def test_awkward_rows(self, spark, library):
        rows = awkward(spark)
        got = token_digests(rows)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        want = [(r.doc_id, len(library(r.text or "")), sha(" ".join(map(str, library(r.text or "")))), sha(r.text or "")) for r in rows.collect()]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert token_digests(rows.limit(0)).collect() == []

    def test_ids_that_the_vocabulary_lacks_are_an_error(self, spark):
        decode = decoder(shared_vocabulary(spark, VOCABULARY))
        ids = spark.createDataFrame([(1, [464, 262]), (2, None), (3, [])], "k int, ids array<int>")
        assert [r.d for r in ids.select("k", decode("ids").alias("d")).orderBy("k").collect()] == [b"The the", None, b""]
        with pytest.raises(Exception, match="outside the vocabulary"):
            spark.createDataFrame([([50256],)], "ids array<int>").select(decode("ids")).collect()


def plain_alignment(rows):
    """Contract columns of (doc_id, text) rows: libraries on whole texts, all pairs of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    a_bytes, b_bytes = ByteLevel(open(BYTE_LEVEL, "rb").read()).tokens, Pieces(open(PIECES, "rb").read()).tokens

    def spans(ids, tokens):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(tokens[i]), i))
            at += len(tokens[i])
        return out

    made, count = [], Counter()
    for doc, text in rows:
        x = spans(a.encode(" " + text, add_special_tokens=False).ids, a_bytes) if text else []
        y = spans(b.encode(text), b_bytes) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(a_bytes[t[2]] for t in x) != want or b"".join(b_bytes[t[2]] for t in y) != want:
            x = y = []
        links, i = [], 0
        for t in x:
            while i < len(y) and y[i][1] <= t[0]:
                i += 1
            j = i
            while j < len(y) and y[j][0] < t[1]:
                links.append((t[2], y[j][2]))
                j += 1
        ends = sorted({t[1] for t in x} & {t[1] for t in y})
        groups = [([t[2] for t in x if lo < t[1] <= hi], [t[2] for t in y if lo < t[1] <= hi]) for lo, hi in zip([0, *ends], ends)]
        made.append((doc, x, y, groups, links))
        count.update(links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    shown = lambda g: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
    return [(doc, len(x), len(y), len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), sha(shown(g)) if x else "") for doc, x, y, g, ls in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class TestAlignment:
    def test_tokenizers_equal_the_libraries(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        a.encode_special_tokens = True
        texts = [*ODD, *random_texts(400, 5)]
        assert ByteLevel(open(BYTE_LEVEL, "rb").read()).encode(texts) == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
        own = Pieces(open(PIECES, "rb").read())
        assert own.by_word and own.encode(texts) == b.encode(texts)

    @pytest.mark.parametrize("bounds", [{}, {"block": 3, "slice_tokens": 5, "at_once": 7}, {"block": 1, "slice_tokens": 1, "at_once": 10_000}])
    def test_equals_all_pairs_of_tokens(self, spark, bounds):
        rows = list(enumerate([*ODD, *random_texts(40 if bounds else 300, 7)])) + [(3, ODD[2]), (3, ODD[2]), (None, "of the"), (None, "of the"), (None, None), (5, ""), (5, None)]
        got = alignment_scores(frame(spark, rows), **bounds)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_alignment(rows), key=repr)

    def test_awkward_rows(self, spark):
        rows = awkward(spark).where("length(text) < 1000 or text is null")
        assert sorted(map(tuple, alignment_scores(rows).collect()), key=repr) == sorted(plain_alignment([(r.doc_id, r.text) for r in rows.collect()]), key=repr)
        assert alignment_scores(rows.limit(0)).collect() == []

    def test_a_long_text_in_slices(self, spark):
        text = LONG[:40_000]
        one, cut = (alignment_scores(frame(spark, [(1, text)]), **how).first() for how in ({}, {"block": 100, "slice_tokens": 1000}))
        assert one == cut and one.n_a > 5000

    def test_groups_and_links_are_given(self, spark):
        r = align(frame(spark, [(1, "of the")])).where("pair is null").first()
        a, b = (x.encode(["of the"])[0] for x in (ByteLevel(open(BYTE_LEVEL, "rb").read()), Pieces(open(PIECES, "rb").read())))
        assert r.whole and r.groups == ";".join(f"{x}|{y}" for x, y in zip(a, b)) and (r.n_a, r.n_b, r.n_groups) == (2, 2, 2)
        assert sorted(r.links) == sorted((x << 20) + y for x, y in zip(a, b)) and r.times == [1, 1]
