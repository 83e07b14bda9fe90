"""License scan by ordered signature rules.

A text's words are matched against rules in order of priority. A rule runs only if all its keywords are in
the text, which one pass over the lower-cased bytes decides for most texts. Matches are intervals of words;
one that lies within a match of higher or equal priority is suppressed. The three base phrases are counted
on their own and always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import utf8_of

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, regex of the name over words joined by one blank, a keyword every match holds.
NAMES = (
    ("agpl", r"(?:gnu )?affero general public license", "affero"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "general"),
    ("gpl", r"gnu general public license", "general"),
    ("gfdl", r"gnu free documentation license", "documentation"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit", r"(?:the )?mit(?: x11)? license", "mit"),
    ("mit-0", r"mit no attribution(?: license)?", "attribution"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd"),
    ("bsd", r"bsd license", "bsd"),
    ("isc", r"isc license", "isc"),
    ("mpl", r"mozilla public license", "mozilla"),
    ("epl", r"eclipse public license", "eclipse"),
    ("edl", r"eclipse distribution license", "eclipse"),
    ("cddl", r"common development and distribution license", "distribution"),
    ("cpl", r"common public license", "common"),
    ("ipl", r"ibm public license", "ibm"),
    ("eupl", r"european union public licen[cs]e", "european"),
    ("cecill", r"cecill(?: [abc])?(?: free software)? licen[cs]e", "cecill"),
    ("artistic", r"artistic license", "artistic"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", r"libpng license", "libpng"),
    ("boost", r"boost software license", "boost"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", ""),
    ("cc0", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", "c"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)", ""),
    ("cc-by-nc-sa", r"(?:cc by nc sa|attribution non ?commercial share ?alike)", ""),
    ("cc-by-nc", r"(?:cc by nc|attribution non ?commercial)", ""),
    ("cc-by-nd", r"(?:cc by nd|attribution no ?deriv(?:ative)?s)", ""),
    ("cc-by-sa", r"(?:cc by sa|attribution share ?alike)", ""),
    ("public-domain", r"(?:released into|dedicated to|placed in) the public domain", "public"),
    ("ofl", r"(?:sil )?open font license", "font"),
    ("odbl", r"open (?:data commons open )?database license", "database"),
    ("odc-by", r"open data commons attribution license", "commons"),
    ("pddl", r"public domain dedication and license", "dedication"),
    ("python", r"python software foundation license", "python"),
    ("php", r"php license", "php"),
    ("ruby", r"ruby license", "ruby"),
    ("openssl", r"openssl license", "openssl"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ncsa", r"(?:university of illinois )?ncsa open source license", "ncsa"),
    ("upl", r"universal permissive license", "permissive"),
    ("ms-pl", r"microsoft public license", "microsoft"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft"),
    ("apsl", r"apple public source license", "apple"),
    ("osl", r"open software license", "open"),
    ("afl", r"academic free license", "academic"),
    ("bsl", r"business source license", "business"),
    ("sspl", r"server side public license", "server"),
    ("elastic", r"elastic license", "elastic"),
    ("vim", r"vim license", "vim"),
    ("w3c", r"w3c (?:software )?(?:notice and )?license", "w3c"),
    ("x11", r"x11 license", "x11"),
)
#: SPDX ids of the labels as words, without their versions. `edl` and `public-domain` have none.
IDS = {
    "agpl": r"agpl", "lgpl": r"lgpl", "gpl": r"gpl", "gfdl": r"gfdl", "apache": r"apache", "mit": r"mit(?! 0 )", "mit-0": r"mit 0",
    "bsd-2-clause": r"bsd 2 clause", "bsd-3-clause": r"bsd 3 clause", "bsd-4-clause": r"bsd 4 clause", "bsd": r"(?:0bsd|bsd(?: 1 clause)?(?! [234] clause))",
    "isc": r"isc", "mpl": r"mpl", "epl": r"epl", "cddl": r"cddl", "cpl": r"cpl", "ipl": r"ipl", "eupl": r"eupl", "cecill": r"cecill(?: [abc])?", "artistic": r"artistic",
    "zlib": r"zlib", "libpng": r"libpng", "boost": r"bsl", "unlicense": r"unlicense", "wtfpl": r"wtfpl", "cc0": r"cc0", "cc-by-nc-nd": r"cc by nc nd", "cc-by-nc-sa": r"cc by nc sa",
    "cc-by-nc": r"cc by nc", "cc-by-nd": r"cc by nd", "cc-by-sa": r"cc by sa", "ofl": r"ofl", "odbl": r"odbl", "odc-by": r"odc by", "pddl": r"pddl", "python": r"(?:psf|python)", "php": r"php",
    "ruby": r"ruby", "openssl": r"openssl", "postgresql": r"postgresql", "ncsa": r"ncsa", "upl": r"upl", "ms-pl": r"ms pl", "ms-rl": r"ms rl", "apsl": r"apsl", "osl": r"osl", "afl": r"afl",
    "bsl": r"busl", "sspl": r"sspl", "elastic": r"elastic", "vim": r"vim", "w3c": r"w3c", "x11": r"x11",
}
#: Abbreviations. Label, regex, keyword, and the kinds of SHORT_FORMS in which it names a license.
SHORTS = (
    ("agpl", r"(?:gnu )?(?:agpl|affero gpl)", "gpl", "grant licensed versioned bare"),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) gpl)", "gpl", "grant licensed versioned bare"),
    ("gpl", r"(?:gnu )?gpl", "gpl", "grant licensed versioned bare"),
    ("gfdl", r"(?:gnu )?(?:gfdl|fdl)", "fdl", "grant licensed versioned"),
    ("apache", r"apache", "apache", "grant licensed"),
    ("apache", r"(?:apache (?:version |v)?2 0|asl (?:version |v)?2(?: 0)?|apl (?:version |v)?2 0)(?! \d)", "2", "bare"),
    ("mit", r"(?:mit(?: x11)?|expat)(?! no attribution)", "", "grant licensed"),
    ("bsd", r"bsd", "bsd", "grant licensed"),
    ("isc", r"isc", "isc", "grant"),
    ("zlib", r"zlib", "zlib", "grant licensed"),
    ("boost", r"boost", "boost", "grant licensed"),
    ("mpl", r"mpl", "mpl", "grant licensed versioned"),
    ("epl", r"epl", "epl", "grant licensed versioned"),
    ("cddl", r"cddl", "cddl", "grant licensed versioned bare"),
    ("cpl", r"cpl", "cpl", "grant licensed versioned"),
    ("eupl", r"eupl", "eupl", "grant licensed versioned bare"),
    ("ofl", r"(?:sil )?ofl", "ofl", "grant licensed versioned"),
    ("odbl", r"odbl", "odbl", "grant licensed versioned bare"),
    ("pddl", r"pddl", "pddl", "grant licensed"),
    ("ncsa", r"ncsa", "ncsa", "grant licensed"),
    ("upl", r"upl", "upl", "grant licensed"),
    ("ms-pl", r"ms pl", "ms pl", "grant licensed bare"),
    ("ms-rl", r"ms rl", "ms rl", "grant licensed bare"),
    ("apsl", r"apsl", "apsl", "grant licensed versioned"),
    ("osl", r"osl", "osl", "grant licensed versioned"),
    ("afl", r"afl", "afl", "grant licensed versioned"),
    ("bsl", r"busl", "busl", "grant licensed versioned"),
    ("sspl", r"sspl", "sspl", "grant licensed versioned bare"),
    ("cecill", r"cecill(?: [abc])?", "cecill", "grant versioned"),
)
_VERSION = r"(?: (?:version |v)?|v?)\d{1,2}(?: \d{1,2})*(?: only| or (?:any )?later(?: version)?)?"
#: Kind: regex around an abbreviation ({}), priority, certainty.
SHORT_FORMS = {
    "grant": (r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?{}(?:" + _VERSION.replace("{", "{{").replace("}", "}}") + ")?", 4, 1.0),
    "versioned": ("{}" + _VERSION.replace("{", "{{").replace("}", "}}"), 3, 0.9),
    "licensed": ("{}(?:" + _VERSION.replace("{", "{{").replace("}", "}}") + r")?(?: style)? licen[cs]e?d?", 2, 0.8),
    "bare": ("{}", 2, 0.6),
}
_ID_VERSION = r"(?: v?\d+(?: \d+)*)?(?: only| or later)?"
_OPERANDS = r"(?:(?:" + "|".join([*IDS.values(), r"cc by(?: (?:nc|nd|sa))*"]) + f"){_ID_VERSION}" + r"(?: with(?: [^ ]+){1,6}? exception(?: \d+)*)? (?:or|and) )+"
#: Kind, regex around a name ({}), priority, certainty. The kinds times the names give the rules.
FORMS = (
    ("grant", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?{}(?: version)?(?: v?\d+(?: \d+)*)?", 4, 1.0),
    ("identifier", r"spdx license identifier {}" + _ID_VERSION, 4, 1.0),
    # what follows `or` and `and` in an identifier's expression; only the operand itself counts as matched
    ("operand", r"spdx license identifier " + _OPERANDS.replace("{", "{{").replace("}", "}}") + "(?P<own>{}" + _ID_VERSION + ")", 4, 1.0),
    ("versioned", r"{} (?:version |v)?\d+(?: \d+)*(?: or (?:any )?later)?", 3, 0.9),
    ("named", r"{}", 2, 0.8),
)
#: Passages that stand for a license without its name. Label, regex, keyword, priority, certainty.
PASSAGES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 4, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 4, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution", 4, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty", "implied", 3, 0.7),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 4, 1.0),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute", 4, 0.9),
    ("apache", r"you may not use this file except in compliance with the license", "compliance", 4, 0.9),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "mozilla", 4, 1.0),
    ("reserved", r"(?:all|some|no) rights reserved(?: worldwide)?", "rights", 2, 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 1, 0.3),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 3, 0.8),
    ("no-redistribution", r"(?:may not|must not|cannot) be (?:reproduced|redistributed|copied)", "be", 3, 0.6),
    ("cc-by", r"creative commons attribution", "commons", 2, 0.8),
)
SCORE_BASE = 0.8

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: For counting words of texts as they are: those bytes and A-Z, which are lower-cased elsewhere.
_IN_WORD = np.array([not (b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
#: Every rule's match holds one of these, and so does every base phrase.
GATES = (b"licen", b"cc by", b"cc0", b"cc-by", b"rights", b"copyright", b"permission", b"wtfpl", b"attribution", b"commons", b"public domain", b"redistribut", b"proprietary", b"affero", b"not be ", b"unencumbered", b"warranty", b"bsd", b"compliance", b"mit no", b"creative", b"cannot be")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    certainty: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first, in the given order within one."""
    own = []
    for kind, form, priority, certainty in FORMS:
        for label, name, key in NAMES:
            if kind in ("identifier", "operand"):
                key, name = "spdx", f"{IDS[label]}|{name}" if label in IDS else name
            own.append(Rule(label, key.encode(), _compiled(form.format(f"(?:{name})")), priority, certainty))
    for kind, (form, priority, certainty) in SHORT_FORMS.items():
        own += [Rule(label, key.encode(), _compiled(form.format(f"(?:{short})")), priority, certainty) for label, short, key, kinds in SHORTS if kind in kinds.split()]
    own += [Rule(label, key.encode(), _compiled(regex), priority, certainty) for label, regex, key, priority, certainty in PASSAGES]
    return tuple(sorted(own, key=lambda r: -r.priority))


def _compiled(regex: str) -> re.Pattern:
    return re.compile(rf"(?<= )(?:{regex})(?= )".encode())


class _Words:
    """Lower-cased words, each with one blank before it and one at the end, and the word numbers of byte offsets."""

    def __init__(self, lowered: bytes):
        self.joined = b" " + b" ".join(_WORD.findall(lowered)) + b" "
        self._blanks = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 0x20).tolist()

    def blanks_before(self, offset: int) -> int:
        return bisect_left(self._blanks, offset)


def _starts(words: _Words, phrase: bytes) -> list[int]:
    """Word numbers where a phrase stands, overlaps included."""
    found, at = [], words.joined.find(b" " + phrase + b" ")
    while at >= 0:
        found.append(words.blanks_before(at))
        at = words.joined.find(b" " + phrase + b" ", at + 1)
    return found


class _Widest:
    """Intervals of which none contains another, so that starts and ends go up together."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def contain(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end

    def add(self, start: int, end: int) -> None:
        """Add an interval that none contains, in place of those that it contains."""
        first, after = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[first : max(first, after)] = [start]
        self.ends[first : max(first, after)] = [end]


def detect(words: _Words) -> list[tuple[int, int, Rule]]:
    """(first word, word after the last, rule) of all matches that no earlier match of any rule contains."""
    kept, widest = [], _Widest()
    for rule in rules():
        if rule.keyword and rule.keyword not in words.joined:
            continue
        for m in rule.pattern.finditer(words.joined):
            first = m.start("own") if "own" in rule.pattern.groupindex else m.start()
            start, end = words.blanks_before(first) - 1, words.blanks_before(m.end())
            if not widest.contain(start, end):
                kept.append((start, end, rule))
                widest.add(start, end)
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def scan_words(lowered: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """(word, label) of the base places of a lower-cased text, and the rules' detections."""
    words = _Words(lowered)
    base = sorted((at, label) for phrase, label in BASE for at in _starts(words, phrase.encode()))
    return base, detect(words)


def _gate() -> re.Pattern:
    # words are matched whatever stands between them, so a blank in a gate stands for any separators
    named = "|".join(re.escape(g.decode()) for g in GATES).replace(r"\ ", " ")
    # an abbreviation counts after `under`, or with a version or on its own if its kinds say so
    under = "under (?:the )?(?:terms of (?:the )?)?(?:" + "|".join(short for _, short, _, kinds in SHORTS if "grant" in kinds) + ")"
    alone = "|".join(short.removeprefix("(?:gnu )?").removeprefix("(?:sil )?") for _, short, _, kinds in SHORTS if "versioned" in kinds or "bare" in kinds)
    return re.compile(f"{named}|{under}|(?:{alone})(?![a-uw-z\x80-\xff])".replace(" ", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+").encode("latin-1"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row of docs.

    Null text counts as empty: no words, no places, empty labels and a score of 0. Repeated rows and null or
    repeated ids are scanned alike; an empty table gives an empty one; other columns are ignored. Rows are scanned
    each on its own; the cost of a long text grows with its length and with its matches times their logarithm.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = _gate()
        for batch in batches:
            flat, offsets = utf8_of(batch.column(1))
            inside = _IN_WORD[flat]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(flat)]
            begins[edges] = inside[edges]
            before = np.concatenate([[0], np.cumsum(begins)])
            n_words = before[offsets[1:]] - before[offsets[:-1]]
            whole, rows = flat.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                lowered = whole[a:b].lower()
                if not gate.search(lowered):
                    rows.append((0, None, None, "", "", 0.0, 0))
                    continue
                base, found = scan_words(lowered)
                labels = {label for _, label in base}
                score = max([r.certainty for _, _, r in found] + [SCORE_BASE] * bool(base), default=0.0)
                places = [at for at, _ in base]
                rows.append((len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {r.label for _, _, r in found})), score, len(found)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            arrays = [batch.column(0), pa.array(n_words, pa.int64())] + [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
    names = [x.split()[0] for x in schema.split(", ")]
    return own.mapInArrow(scan, schema)
