"""Phrase growth against plain counting."""

import random
import re
from collections import Counter

import pytest

from lexloom.llm.collocations import collocations, grow
from tests.llm.helpers import LONG, awkward, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, longest=3, top=2000):
    """Contract rows of (doc_id, text, lang) by counting every run of words."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = [a2 for (l2, q), a2 in f.items() if l2 == lang and len(q) > len(p) and a2 >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * x >= 50 * a for x in inside):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def made(n, seed=2):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "new", "york", "city", "a", "😀", "x\x1cy", " b"]
    return [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", ", "\x0b"]) for _ in range(r.randrange(80))), r.choice(["en", "de", None, "und"])) for i in range(n)]


class TestCollocations:
    @pytest.mark.parametrize("pointers_a_task", [4_000_000, 50])
    def test_equals_counting(self, spark, pointers_a_task):
        rows = made(120) + [(1, None, "en"), (2, "", None), (None, "new york city " * 30, "fr"), (7, "new york city " * 30, "fr"), (7, "new york city " * 30, "fr")]
        got = collocations(frame(spark, rows), pointers_a_task=pointers_a_task)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows)

    @pytest.mark.parametrize("longest", [2, 4])
    def test_other_lengths_and_parts(self, spark, longest):
        rows = made(60, 5)
        got = collocations(frame(spark, rows), least=4, most_words=longest, top=30, pointers_a_task=40)
        assert sorted(map(tuple, got.collect())) == plain(rows, 4, longest, 30)

    def test_awkward_rows(self, spark):
        rows = awkward(spark)
        assert sorted(map(tuple, collocations(rows).collect())) == plain([(r.doc_id, r.text, r.lang) for r in rows.collect()])
        assert collocations(rows.limit(0)).collect() == [] and LONG

    def test_scores_are_exact_beyond_64_bits(self, spark):
        # a * a * 1000000 passes 2**63 for a = 4 million
        rows = [(i, "p q " * 1_000_000, "en") for i in range(4)]
        r = collocations(frame(spark, rows), most_words=2).where("phrase = 'p q'").first()
        assert (r.a, r.l, r.r, r.score) == (4_000_000, 4_000_000, 4_000_000, 1_000_000)

    def test_growth_is_right_of_the_prefix_only(self):
        got = dict(grow(b"a", [[b"b", b"b", b"b", b"b", b"", b"", b"c"], [b"c", b"d", b"d", b"", b"", b"", b"b"]], [3, 1, 1, 1, 9, 1, 1], 2, False))
        assert got == {b"a b": 6, b"a b c": 3, b"a b d": 2}
