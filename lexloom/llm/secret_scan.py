"""Secret scans: fixed patterns, and strings that a public vocabulary needs unusually many tokens for."""

from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame

from lexloom.llm.common import map_batches

KINDS = ("assign", "access", "hex", "token")
#: Where the public tokenizers' vocabulary lies; a parameter of the operator. The driver reads it, executors get a broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern by which the vocabulary splits text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate is any run of these characters: only its tokens tell whether it is random.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Digests of fixed length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex), UUIDs, dates with times, and paths are known identifiers.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d{2}-\d{2}T?[\d:Z+-]*)\Z")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three fixed patterns; matches that are too short are dropped, not retried."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def token_spans(text: str, encode, most_chars_per_token: float) -> list[tuple[int, int, str]]:
    """Runs whose characters per token are at most the limit, known digests and identifiers excluded."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not KNOWN.match(run) and len(run) <= most_chars_per_token * len(encode(run)):
            out.append((m.start(), m.end(), "token"))
    return out


def load_encoding(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


_loaded: dict[str, object] = {}


def _encoder(ranks_file: bytes):
    key = hashlib.sha256(ranks_file).hexdigest()
    if key not in _loaded:
        _loaded[key] = load_encoding(ranks_file)
    return _loaded[key].encode_ordinary


def secret_scan(docs: DataFrame, vocabulary: str = VOCABULARY, most_chars_per_token: float = 2.0) -> DataFrame:
    """doc_id, counts of the fixed kinds, their digest, and all spans with the method's own, for every row of ``docs``.

    A null text counts as empty: no spans, and the digest of the empty string. Offsets are code points, end exclusive.
    A token span that lies within a base span is not repeated. ``vocabulary``: path of a tiktoken rank file, under 1 MB.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encode = _encoder(ranks.value)

        def one(text: str | None) -> tuple:
            base = base_spans(text or "")
            found = [s for s in token_spans(text or "", encode, most_chars_per_token) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
            count = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            return *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + found), len(found)

        def apply(cols):
            rows = zip(*map(one, cols["text"].to_pylist()))
            return {"doc_id": cols["doc_id"]} | {n: list(v) for n, v in zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"), rows)}

        return apply

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long", make)
