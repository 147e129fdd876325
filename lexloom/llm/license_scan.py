"""License scans by sentences: known licence sentences get identifiers, ordered rules over identifiers name the licence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from lexloom.llm.common import map_batches

#: Licence sentences as patterns over the normalised sentence (lower case, words and digits, single blanks).
SENTENCES = (
    ("gpl_notice", r"(?:this (?:work|file|program|software|library) is )?(?:licensed|released|distributed) under (?:the terms of )?the gnu general public license(?: version (?P<v>[0-9.]+))?(?: or any later version)?"),
    ("lgpl_notice", r"(?:this (?:work|file|program|software|library) is )?(?:licensed|released|distributed) under (?:the terms of )?the gnu lesser general public license(?: version (?P<v>[0-9.]+))?(?: or any later version)?"),
    ("agpl_notice", r"(?:this (?:work|file|program|software|library) is )?(?:licensed|released|distributed) under (?:the terms of )?the gnu affero general public license(?: version (?P<v>[0-9.]+))?(?: or any later version)?"),
    ("gpl_redistribute", r"(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either version (?P<v>[0-9.]+) of the license or at your option any later version)?"),
    ("gpl_hope", r"this (?:program|library|file) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl_copy", r"you should have received a copy of the gnu general public license along with this program.*"),
    ("apache_notice", r"(?:this (?:work|file|program|software) is )?(?:licensed|released|distributed) under the apache license(?: version)?(?: (?P<v>[0-9.]+))?(?: the license)?"),
    ("apache_comply", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at.*"),
    ("apache_as_is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit_notice", r"(?:this (?:work|file|program|software) is )?(?:licensed|released|distributed) under the (?:mit|expat) license"),
    ("mit_permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit_condition", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_as_is", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("bsd_notice", r"(?:this (?:work|file|program|software) is )?(?:licensed|released|distributed) under (?:the|a) (?P<v>[0-9]) clause bsd license"),
    ("bsd_permission", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd_source", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd_binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd_endorse", r"(?:3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products.*"),
    ("cc_notice", r"(?:this (?:work|file|text) is )?(?:licensed|released|distributed) under (?:a |the )?(?:creative commons |cc )(?P<v>(?:by|zero|0)(?: nc| sa| nd)*(?: [0-9.]+)?)(?: license)?"),
    ("mpl_notice", r"this source code form is subject to the terms of the mozilla public license v (?P<v>[0-9.]+)"),
    ("public_domain", r"this (?:work|file|software) is (?:in|released into|dedicated to) the public domain"),
    ("rights_reserved", r"all rights reserved"),
)
#: Ordered rules. The first whose identifiers stand in this order, others between, takes them; then the next.
RULES = (
    ("MIT", ("mit_permission", "mit_condition", "mit_as_is")),
    ("BSD-3-Clause", ("bsd_permission", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_permission", "bsd_source", "bsd_binary")),
    ("Apache", ("apache_notice", "apache_comply", "apache_copy", "apache_as_is")),
    ("GPL", ("gpl_redistribute", "gpl_hope", "gpl_copy")),
    ("AGPL", ("agpl_notice",)),
    ("LGPL", ("lgpl_notice",)),
    ("GPL", ("gpl_redistribute",)),
    ("GPL", ("gpl_notice",)),
    ("Apache", ("apache_notice",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_permission",)),
    ("BSD", ("bsd_notice",)),
    ("CC", ("cc_notice",)),
    ("MPL", ("mpl_notice",)),
    ("public-domain", ("public_domain",)),
    ("all-rights-reserved", ("rights_reserved",)),
)
_PATTERNS = [(name, re.compile(p)) for name, p in SENTENCES]
#: Each licence sentence holds one of these words; text without them is not cut into sentences.
HINT = re.compile(r"licen[sc]e|permission|redistribut|warrant|public[\W_]+domain|rights[\W_]+reserved|copyright[\W_]+notice|names[\W_]+of[\W_]+its", re.I)
#: Known sentences begin with one of these words.
BEGIN = re.compile(r"(?:this|licensed|released|distributed|you|unless|permission|the|redistributions?|neither|all|[123])\b")
#: What a comment puts before its lines: marks, and the words of some languages.
PREFIX = re.compile(r"[ \t]*(?:(?:[^\w\s(\"'\[<]+|rem|dnl)(?=\s|\Z)[ \t]*)?", re.I)
WORD = re.compile(r"[^\W_]")
#: A piece ends at a line's end, or at . ! ? ; before a blank; a point between digits ends none.
SENTENCE = re.compile(r"[^\n.!?;]*(?:[.!?;](?!\s|\Z)[^\n.!?;]*)*(?:[.!?;]|\n|\Z)")


def normalised(sentence: str) -> str:
    """Lower case; words, and numbers with their points; single blanks."""
    return " ".join(re.findall(r"[0-9]+(?:\.[0-9]+)*|[^\W_]+", sentence.lower()))


def known(pieces: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """Known sentences among ``pieces`` (start, end, text by line) of one run without a full stop.

    A sentence may start and end at any line's end, as titles and list heads have no mark. From each line on, the longest
    is taken; a line after which no known sentence begins, however long, costs one look.
    """
    norms, out, i = [normalised(p[2]) for p in pieces], [], 0
    while i < len(pieces):
        step = 1
        if BEGIN.match(norms[i]):
            whole = " ".join(norms[i:])
            likely = [(name, pattern) for name, pattern in _PATTERNS if pattern.match(whole)]
            for j in range(len(pieces), i, -1) if likely else ():
                norm = " ".join(norms[i:j])
                if found := next(((name, got) for name, pattern in likely if (got := pattern.fullmatch(norm))), None):
                    version = (found[1].groupdict().get("v") or "").replace(" ", "-").upper()
                    out.append((pieces[i][0], pieces[j - 1][1], found[0], version))
                    step = j - i
                    break
        i += step
    return out


def sentences(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, identifier, version) of every known sentence, which may be wrapped over lines and stand in comments.

    Sentences end at a mark, or at a line without words. Only runs of lines with a hint are looked at.
    """
    out, run, line_start = [], [], 0

    def close() -> None:
        if run and HINT.search(text, run[0][0], run[-1][1]):
            out.extend(known(run))
        run.clear()

    for line in text.split("\n"):
        begin = PREFIX.match(line).end()
        if not WORD.search(line, begin):
            close()
        else:
            for m in SENTENCE.finditer(line, begin):
                if WORD.search(m[0]):
                    run.append((line_start + (m.start() if m.start() > begin else 0), line_start + m.end(), m[0]))
                    if m[0][-1] in ".!?;":
                        close()
        line_start += len(line) + 1
    close()
    return out


def licenses(found: list[tuple[int, int, str, str]]) -> list[str]:
    """Licences by the ordered rules, in the order of their first sentence; identifiers serve one rule each."""
    free, out = list(range(len(found))), []
    for name, wanted in RULES:
        while True:
            taken: list[int] = []
            for i in free:
                if len(taken) < len(wanted) and found[i][2] == wanted[len(taken)]:
                    taken.append(i)
            if len(taken) < len(wanted):
                break
            version = next((found[i][3] for i in taken if found[i][3]), "")
            out.append((taken[0], f"{name}-{version}" if version else name))
            free = [i for i in free if i not in taken]
    return [n for _, n in sorted(out)]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses and spans for every row of ``docs``.

    ``sentence_ids``: identifiers in text order; ``licenses``: distinct names in order; ``spans``: start:end of each
    sentence; all comma-joined. Null and empty texts, and texts without known sentences, have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def one(text: str | None) -> tuple:
            if not text or not HINT.search(text):
                return 0, "", "", ""
            found = sentences(text)
            return len(found), ",".join(f[2] for f in found), ",".join(dict.fromkeys(licenses(found))), ",".join(f"{f[0]}:{f[1]}" for f in found)

        def apply(cols):
            rows = zip(*map(one, cols["text"].to_pylist()))
            return {"doc_id": cols["doc_id"]} | {n: list(v) for n, v in zip(("n_sentences", "sentence_ids", "licenses", "spans"), rows)}

        return apply

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_sentences long, sentence_ids string, licenses string, spans string", make)
