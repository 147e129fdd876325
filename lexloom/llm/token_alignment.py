"""Alignment of two tokenizers over every text: a sweep over token ends, and how often corpus-wide two ids are linked.

1. Each text is encoded by A (byte-level BPE, over a blank and the text) and by B (sentencepiece, which adds the blank). Every
   token is an event at the byte offset where it ends. Events of both sides are united, repartitioned by document and sorted
   by offset. A row holds a run of consecutive events of one side (``BLOCK`` at most), named by the offset where it begins, as a
   row for each event would cost ten times the events.
2. A state machine streams through each partition. Its state is the open document: the offset of the last common end and the
   tokens of each side behind it, at most a block and a group. Common ends close groups; tokens of a group whose byte ranges
   overlap are links. Per document it emits the groups as text and the links as counted id pairs, and per slice the pairs' sums.
3. Sums by pair give the corpus-wide counts and the highest count of each B id. Documents' links are scored against the
   counts, which come as broadcasts of ``PAIRS_AT_ONCE`` pairs at most, one pass over the links for each. Pairs that are
   linked once in the whole corpus need no broadcast.

Texts are told apart by id and a 128-bit hash; rows of equal id and text are one document with ``copies``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.llm.byte_bpe import PATTERN, REMEMBERED
from lexloom.llm.common import Scratch, all_of

#: Where the public files lie; parameters of the operator.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK, SLICE_TOKENS, SLICE_BYTES, PAIRS_AT_ONCE = 4096, 400_000, 1_000_000, 1 << 21
#: A pair of ids as one number: the A id times this, and the B id.
SHIFT = 20
A, B, NOTHING = 0, 1, 2
EVENT = "key binary, at long, side int, copies long, ids binary"
ALIGNED = "key binary, piece int, whole boolean, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>, pair long, pair_n long"


def byte_of_char() -> dict[str, int]:
    """The byte for each printable stand-in of the byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A, from the bytes of its JSON file.

    Where merges stand in the order of their ids the rank of a merge is its id, and the tiktoken library gives the same ids
    in a fraction of the time; otherwise the tokenizers library encodes.
    """

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in special}
        self.tokens = [tokens.get(i, b"") for i in range(max(*tokens, *special.values(), 0) + 1)]
        joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        ahead = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and ahead.get("type") == "ByteLevel" and ahead.get("use_regex") and not ahead.get("add_prefix_space") and not spec["model"].get("ignore_merges")
        if plain and all(x < y for x, y in zip(joined, joined[1:])) and joined[0] > max(i for i, t in tokens.items() if len(t) == 1):
            import tiktoken

            one = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={}).encode_ordinary
            self.encode = lambda texts: [one(" " + t) for t in texts]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(file.decode())
            library.encode_special_tokens = True
            self.encode = lambda texts: [library.encode(" " + t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """Tokenizer B, from the bytes of its model file.

    Where no piece has a blank behind another character, and blanks are kept as they are, words with the blanks before them are
    encoded alone, each different word once; otherwise whole texts are.
    """

    def __init__(self, file: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        shown = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.tokens = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        probe = "".join(self.model.encode("a  b c ", out_type=str))
        self.by_word = probe == "▁a▁▁b▁c▁" and not any("▁" in p.lstrip("▁") for p in shown)
        self.words, self.known = re.compile(r" *[^ ]+(?: +\Z)?").findall, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.model.encode(texts, num_threads=1)
        cut = [self.words(t) or [t] for t in texts]
        # only a text's first word can lack a blank, which the model adds
        cut = [[c[0] if c[0][0] != " " else " " + c[0], *c[1:]] for c in cut]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for c in cut for w in c}.difference(self.known))
        self.known.update(zip(new, self.model.encode([w[1:] if w[0] == " " else w for w in new], num_threads=1)))
        return [[i for w in c for i in self.known[w]] for c in cut]


_workers: dict[bytes, tuple] = {}


def tokenizers(files: tuple[bytes, bytes]) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, built once in each worker process."""
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = ByteLevel(files[0]), Pieces(files[1])
    return _workers[key]


def _width(*sizes: int) -> str:
    return "<u2" if max(sizes) <= 1 << 16 else "<u4"


def events(docs: DataFrame, files, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, at, side, copies, ids): runs of token ends of both sides of every text of (doc_id, text).

    A text that is null or empty, or whose tokens don't give back a blank and the text, is one row of side ``NOTHING``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = T._parse_datatype_string(f"doc_id {kind}, {EVENT}")

    def rows_of(ids: list, texts: list, a: ByteLevel, b: Pieces) -> list[tuple]:
        seen: dict[tuple, int] = {}
        for row in zip(ids, texts):
            seen[row] = seen.get(row, 0) + 1
        different = list({t for _, t in seen if t})
        found, width = {}, _width(len(a.tokens), len(b.tokens))
        for text, x, y in zip(different, a.encode(different), b.encode(different)):
            want, runs = (" " + text).encode(), []
            for side, tokens, got in ((A, a.tokens, x), (B, b.tokens, y)):
                if b"".join(map(tokens.__getitem__, got)) != want:
                    runs = []
                    break
                at = 0
                for i in range(0, len(got), block):
                    run = got[i : i + block]
                    runs.append((at, side, np.array(run, width).tobytes()))
                    at += sum(len(tokens[t]) for t in run) if i + block < len(got) else 0
            found[text] = xxhash.xxh3_128_digest(text.encode()), runs
        out = []
        for (doc, text), n in seen.items():
            key, runs = found[text] if text else (b"", [])
            out += [(doc, key, at, side, n, run) for at, side, run in runs or [(0, NOTHING, b"")]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (a, b) = to_arrow_schema(fields), tokenizers(files.value)
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
            cuts = np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                cols = list(zip(*rows_of(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), a, b))) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


class Sweep:
    """The state machine: takes slices of sorted runs, keeps what stands open behind the last common end."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.width = _width(len(a), len(b))
        self.lengths = tuple(np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
        self.ids = max(len(a), len(b))
        if self.ids > 1 << SHIFT:
            raise ValueError(f"a vocabulary has over {1 << SHIFT} ids")
        self.shown = [f"{i}{s}" for s in ",|;" for i in range(self.ids)]
        self.open, self.piece, self.base, self.left = None, 0, 0, (np.zeros(0, np.int64),) * 2

    def side(self, side: int, docs: list, rows: list) -> tuple[np.ndarray, ...]:
        """(ids, ordinals of documents, places) of one side; places are ordinal and end offset in one number."""
        mine = [(o, r) for o, r in rows if r[3] == side]
        parts = [np.frombuffer(r[5], self.width).astype(np.int64) for _, r in mine]
        ids = np.concatenate([self.left[side], *parts])
        ordinal = np.concatenate([np.zeros(len(self.left[side]), np.int64), np.repeat([o for o, _ in mine], [len(p) for p in parts]).astype(np.int64)])
        total = np.cumsum(self.lengths[side][ids])
        first = np.flatnonzero(np.diff(ordinal, prepend=-1))
        before = np.concatenate([[0], total])[first]
        before[ordinal[first] == 0] -= self.base
        ends = total - np.repeat(before, np.diff(np.append(first, len(ids))))
        return ids, ordinal, ordinal << 40 | ends

    def step(self, docs: list[list], rows: list[tuple], final: bool) -> Iterator[tuple]:
        """Output rows for ``docs`` ([doc_id, key, copies]); ``rows`` are (ordinal, run). ``final``: the last document ends here.

        The first document may be the one that the slice before left open, whose state then counts; otherwise state is fresh.
        """
        if self.open != (docs[0][0], docs[0][1]):
            self.piece, self.base, self.left = 0, 0, (np.zeros(0, np.int64),) * 2
        (ids_a, ord_a, at_a), (ids_b, ord_b, at_b) = self.side(A, docs, rows), self.side(B, docs, rows)
        place = np.searchsorted(at_b, at_a)
        hit_a = at_b[np.minimum(place, len(at_b) - 1)] == at_a if len(at_b) else np.zeros(len(at_a), bool)
        hits = np.flatnonzero(hit_a)
        n_a, n_b = (hits[-1] + 1, place[hits[-1]] + 1) if len(hits) else (0, 0)
        if final and (n_a < len(ids_a) or n_b < len(ids_b)):
            raise RuntimeError("a document's sides end at different offsets")
        last = len(docs) - 1
        if n_a and ord_a[n_a - 1] == last:
            base = int(at_a[n_a - 1]) & ((1 << 40) - 1)
        else:
            base = self.base if last == 0 else 0
        left = ids_a[n_a:], ids_b[n_b:]
        hit_b = np.zeros(n_b, bool)
        hit_b[place[hits]] = True
        ids_a, ord_a, at_a, hit_a, ids_b, ord_b, at_b = ids_a[:n_a], ord_a[:n_a], at_a[:n_a], hit_a[:n_a], ids_b[:n_b], ord_b[:n_b], at_b[:n_b]

        # links: for each A token the run of B tokens that end behind its start and start before its end
        low = np.searchsorted(at_b, at_a - self.lengths[A][ids_a], "right")
        high = np.searchsorted(at_b - self.lengths[B][ids_b], at_a, "left")
        n = high - low
        b_of = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        coded, times = np.unique((np.repeat(ord_a << SHIFT | ids_a, n) << SHIFT) | ids_b[b_of], return_counts=True)
        owner, pair = coded >> 2 * SHIFT, coded & ((1 << 2 * SHIFT) - 1)

        # groups as text: A tokens of a group, then its B tokens
        group_a, group_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
        in_a, in_b = np.bincount(group_a, minlength=len(hits)), np.bincount(group_b, minlength=len(hits))
        shown = np.zeros(n_a + n_b, np.int64)
        shown[np.arange(n_a) + np.concatenate([[0], np.cumsum(in_b)])[group_a]] = hit_a * self.ids + ids_a
        shown[np.arange(n_b) + np.cumsum(in_a)[group_b]] = 2 * hit_b * self.ids + ids_b
        text = list(map(self.shown.__getitem__, shown.tolist()))

        count = lambda x, **kw: np.bincount(x, minlength=len(docs), **kw).astype(np.int64)
        of_a, of_b, groups, links = count(ord_a), count(ord_b), count(ord_a[hit_a]), count(ord_a, weights=n)
        text_ends, pair_ends = np.cumsum(of_a + of_b), np.cumsum(count(owner))
        copies = np.array([d[2] for d in docs], np.int64)
        for i, (doc, key, n_copies) in enumerate(docs):
            p = slice(pair_ends[i - 1] if i else 0, pair_ends[i])
            piece = self.piece if i == 0 else 0
            shown_i = "".join(text[text_ends[i - 1] if i else 0 : text_ends[i]])[:-1]
            yield doc, key, piece, piece == 0 and (i < last or final), n_copies, of_a[i], of_b[i], groups[i], links[i], shown_i, pair[p], times[p].astype(np.int32), None, None
        pairs, where = np.unique(pair, return_inverse=True)
        # sums of whole numbers stay exact in doubles up to 2**53, which no slice reaches
        sums = np.bincount(where, weights=times * copies[owner].astype(float), minlength=len(pairs)).astype(np.int64)
        if len(pairs) and float(sums.max()) > 2**52:
            raise OverflowError("more copies of a document than a slice can count")
        for at in range(0, len(pairs), 50_000):
            yield pairs[at : at + 50_000], sums[at : at + 50_000]
        self.piece = 0 if final else (self.piece if last == 0 else 0) + 1
        self.open, self.base, self.left = (None if final else (docs[last][0], docs[last][1])), base, left


def sweep(sorted_events: DataFrame, files, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """Rows of ``ALIGNED`` for runs that are partitioned by (doc_id, key) and sorted by (doc_id, key, at, side)."""
    fields = T._parse_datatype_string(f"doc_id {sorted_events.schema['doc_id'].dataType.simpleString()}, {ALIGNED}")

    def batch_of(schema: pa.Schema, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        documents = [r for r in found if len(r) > 2]
        cols = list(zip(*documents)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        for pairs, sums in (r for r in found if len(r) == 2):
            none = [pa.nulls(len(pairs), f.type) for f in schema][:-2]
            yield pa.RecordBatch.from_arrays([*none, pa.array(pairs), pa.array(sums)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (a, b) = to_arrow_schema(fields), tokenizers(files.value)
        state, docs, rows, size, last = Sweep(a.tokens, b.tokens), [], [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                doc, key, at, side, copies, run_ = row
                if (doc, key, at, side) == last:  # the same run of an equal row
                    docs[-1][2] += copies if at == 0 and side != B else 0
                    continue
                same = bool(docs) and (docs[-1][0], docs[-1][1]) == (doc, key)
                if size >= slice_tokens or len(docs) >= 10_000:
                    yield from batch_of(schema, list(state.step(docs, rows, not same)))
                    docs, rows, size = [[doc, key, docs[-1][2]]] if same else [], [], 0
                if not same:
                    docs.append([doc, key, copies])
                rows.append((len(docs) - 1, row))
                size += len(run_) // 2
                last = doc, key, at, side
        if docs:
            yield from batch_of(schema, list(state.step(docs, rows, True)))

    return sorted_events.select("doc_id", "key", "at", "side", "copies", "ids").mapInArrow(run, fields)


def read_files(spark: SparkSession, byte_level: str, pieces: str, most: int = 64 << 20):
    """Both files as a broadcast; files over ``most`` bytes are refused."""
    files = Path(byte_level).read_bytes(), Path(pieces).read_bytes()
    if sum(map(len, files)) > most:
        raise ValueError(f"the tokenizers' files have over {most} bytes")
    return spark.sparkContext.broadcast(files)


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block: int = BLOCK, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """Groups and links of every text of (doc_id, text).

    Document rows (``pair`` is null): ``groups`` as text, ids of A and of B between bars and semicolons; ``links``, the linked
    id pairs (A id times 2**20 and B id) with their ``times`` in the document. A document longer than a slice has several rows,
    numbered by ``piece``, of which texts, counts and links are parts. Equal rows are one, with ``copies``. Pair rows: ``pair`` and
    ``pair_n``, partial sums of its links over all documents. ``block`` and ``slice_tokens`` bound what a row and a step hold.
    """
    files = read_files(docs.sparkSession, byte_level, pieces)
    united = events(docs, files, block).repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "at", "side")
    return sweep(united, files, slice_tokens)


def scored(links: DataFrame, counts: DataFrame, best: np.ndarray, scratch: Scratch, at_once: int) -> list[DataFrame]:
    """(doc_id, key, n_best, count_sum) parts that add up to each document's; one pass for each ``at_once`` pairs of ``counts``.

    Every link counts one, and is best where the highest count of its B id is 1. A pass adds what pairs of higher counts
    have beyond that.
    """
    spark = links.sparkSession
    often = counts.where("n > 1")
    passes = max(1, -(-often.count() // at_once))
    out, kind = [], links.schema["doc_id"].dataType.simpleString()
    for k in range(passes):
        table = often.where(F.pmod(F.xxhash64("pair"), F.lit(passes)) == k).toArrow()
        pairs = np.asarray(table.column("pair"), np.int64)
        order = np.argsort(pairs)
        shared = spark.sparkContext.broadcast((pairs[order], np.asarray(table.column("n"), np.int64)[order], best, k == 0))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pairs, n, best, first = shared.value
            for batch in batches:
                flat, times = (np.asarray(batch.column(c).flatten(), np.int64) for c in ("links", "times"))
                top = best[flat & ((1 << SHIFT) - 1)]
                at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
                here = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
                count = n[at] if len(pairs) else np.ones(len(flat), np.int64)
                hits = times * ((here & (count == top)) | (first & (top == 1)))
                sums = times * (np.where(here, count - 1, 0) + int(first))
                ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("links").value_lengths(), np.int64))])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(total(hits)), pa.array(total(sums))], names=["doc_id", "key", "n_best", "count_sum"])

        out.append(scratch.write(links.mapInArrow(run, f"doc_id {kind}, key binary, n_best long, count_sum long"), "alignment-scores"))
        shared.destroy()
    return out


def alignment_scores(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, at_once: int = PAIRS_AT_ONCE, **bounds) -> DataFrame:
    """For every row of ``docs``: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; other columns aren't carried.

    ``n_best``: links whose pair is linked as often as any pair of its B id, over all rows; ``count_sum``: over links, how often their
    pair is linked. Null, empty and irreversible texts have zeros and an empty digest; repeated rows and null ids count and come
    out as often as they stand. The result reads tables in the shared folder.
    """
    scratch, keep = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    found = align(docs, byte_level, pieces, **bounds)
    whole = F.when(F.col("pair").isNull() & F.col("whole") & (F.col("n_a") > 0), F.sha2("groups", 256)).alias("digest")
    found = scratch.write(found.select("*", whole).withColumn("groups", F.when(F.col("digest").isNull(), F.col("groups"))), "alignment")
    counts = scratch.write(found.where("pair is not null").groupBy("pair").agg(F.sum("pair_n").alias("n")), "alignment-pairs")
    tops = counts.groupBy(F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b")).agg(F.max("n").alias("n")).toArrow()  # a row for each id of B at most
    best = np.zeros(1 << SHIFT, np.int64)
    best[np.asarray(tops.column("b"), np.int64)] = np.asarray(tops.column("n"), np.int64)
    documents = found.where("pair is null")
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    shape = ["doc_id", "key", *sums, "n_best", "count_sum", "copies", "digest", "piece", "groups"]
    plain = documents.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).select(*shape)
    parts = [p.select("doc_id", "key", *[F.lit(0).cast("long").alias(c) for c in sums], "n_best", "count_sum", *[F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in shape[8:]]) for p in scored(documents.select("doc_id", "key", "links", "times"), counts, best, scratch, at_once)]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("groups") != "", F.struct("piece", "groups")))), lambda g: g["groups"]), ";")
    one = all_of([plain, *parts]).groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in (*sums, "n_best", "count_sum")], F.max("copies").alias("copies"), F.max("digest").alias("digest"), text.alias("text"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.coalesce("digest", F.sha2("text", 256)))
    result = keep.write(one.select("doc_id", *sums, "n_best", "count_sum", digest.alias("groups_sha256"), "copies"), "alignment-result")
    scratch.drop()
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")
