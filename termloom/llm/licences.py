"""License scans: exact phrases, and short notices within a bounded number of errors.

A notice of which k characters may be wrong is cut into k + 1 pieces, one of which must stand exactly in
any occurrence; an automaton finds all pieces of all notices in one pass, and the regex library's
bounded-error matching checks the text around each piece and gives span and errors.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Short notices in normalised words, and their labels.
NOTICES = (
    ("apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("creative commons zero", "cc0"),
    ("this work is in the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
    ("no part of this publication may be reproduced", "reserved"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("spdx license identifier bsd", "bsd"),
    ("spdx license identifier gpl", "gpl"),
    ("spdx license identifier lgpl", "lgpl"),
    ("spdx license identifier mpl", "mpl"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("boost software license", "boost"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("microsoft public license", "ms-pl"),
    ("server side public license", "sspl"),
    ("sil open font license", "ofl"),
    ("gnu free documentation license", "gfdl"),
)
#: One error in so many characters of a notice.
CHARS_PER_ERROR = 10
_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal_words(text: bytes) -> list:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in lower case (A-Z only)."""
    return text.lower().translate(_TO_SPACE).split()


class Notices:
    """Seeds and verifiers of a list of (notice, label)."""

    def __init__(self, notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR):
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        by_seed: dict = {}
        for i, (notice, label) in enumerate(notices):
            k = len(notice) // chars_per_error
            self.notices.append((label, k, len(notice), regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice, special_only=True)}){{e<={k}}}(?= )")))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                by_seed.setdefault(notice[a:b], []).append((i, a))
        for seed, uses in by_seed.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def find(self, padded: str) -> list:
        """(label, start, end, errors, length) of the occurrences in words joined and padded by blanks."""
        spans: dict = {}
        for end, (size, uses) in self.seeds.iter(padded):
            for i, offset in uses:
                _, k, length, _ = self.notices[i]
                start = end - size + 1 - offset
                a, b = max(0, start - k - 1), min(len(padded), start + length + k + 1)
                last = spans.setdefault(i, [])
                if last and a <= last[-1][1]:
                    last[-1][1] = max(b, last[-1][1])
                    last[-1][0] = min(a, last[-1][0])
                else:
                    last.append([a, b])
        found = []
        for i, windows in spans.items():
            label, _, length, pattern = self.notices[i]
            while windows:
                a, b = windows.pop()
                m = pattern.search(padded, a, b)
                if m:
                    # The best match of a window; worse ones may stand before it and after it.
                    windows += [[m.end(), b], [a, m.start()]]
                    found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), length))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def word_numbers(padded: bytes, at: list) -> list:
    """The number of the word that starts after the blank at each place."""
    blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20)
    return np.searchsorted(blanks, at).tolist()


def base_places(padded: bytes) -> list:
    """(label, number of the first word) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        whole = b" " + phrase.encode() + b" "
        at = padded.find(whole)
        while at >= 0:
            out.append((label, at))
            at = padded.find(whole, at + 1)
    return list(zip([label for label, _ in out], word_numbers(padded, [at for _, at in out]), strict=True)) if out else []


SPAN = pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64())])
_OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_TYPES = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(SPAN))


def _row(text: bytes, notices: Notices) -> tuple:
    words = normal_words(text)
    padded = b" " + b" ".join(words) + b" "
    base = base_places(padded)
    starts, labels = [w for _, w in base], {x for x, _ in base}
    found = notices.find(s := padded.decode("utf-8", "replace"))
    # Places in characters, of which each blank is one: the blanks before give the word, in bytes as in characters.
    blanks = np.array([i for i, c in enumerate(s) if c == " "]) if found else ()
    number = np.searchsorted(blanks, [a for _, a, *_ in found]).tolist() if found else []
    spans = [(x, w - 1, s[a:b].count(" ") + 1, e) for (x, a, b, e, _), w in zip(found, number, strict=True)]
    score = 1.0 if base else max((1 - e / n for *_, e, n in found), default=0.0)
    joined = lambda xs: ",".join(sorted(xs))
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        joined(labels), joined(labels | {x for x, *_ in found}), score,
        [dict(zip(("label", "word", "n_words", "errors"), x, strict=True)) for x in spans],
    )


def _scan(notices):
    def run(batches):
        known = Notices(notices)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch):
                rows = [_row(t, known) for t in texts]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.record_batch([ids.slice(at, len(texts)), *cols], ["doc_id", *_OUT])

    return run


def scan_licences(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base (places of base phrases), first_word
    and last_word (their smallest and largest start), base_labels, labels (base and notices, sorted),
    score (1 with a base phrase, else one less the share of wrong characters of the best notice, else 0),
    spans (notices: label, first word, words, errors).

    Null and empty texts have no words, places or labels and score 0. Rows are independent: repeated rows,
    null ids and ties need no rule; an empty table gives no rows. Very long texts are searched whole, only around
    the seeds that one pass finds. Other columns are left out.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,n_words:long,errors:long>>"
    return docs.select("doc_id", "text").mapInArrow(_scan(notices), schema)


def op7_licence_scan(spark, sf_dir):
    """scan_licences() of all documents; spans as label:word:words:errors, in order, joined by commas."""
    told = lambda s: F.concat_ws(":", s["label"], *(s[c].cast("string") for c in ("word", "n_words", "errors")))
    return scan_licences(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(F.transform("spans", told), ","))
