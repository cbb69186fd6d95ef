"""License scans with a positional rare-token index.

Templates are short texts of licences, cut into words of letters and digits. The index holds, for every template
word, the templates and places it has. Words are weighed by their inverse document frequency, counted over all files.
A file's words are looked up from the rarest down: the rarest word of a template's mandatory key phrases has to be there, and
each of the template's rarest words (``ANCHORS`` of them) votes for the place where the template would start. A start with enough votes is verified: the template's mandatory key phrases must stand
at their places (or as near as the template allows), word for word. The score is the greatest share of a verified
template's words that stand at their place.

The short phrases of the base are templates whose key phrase is the whole template and that need every vote, so all
their places are found, however often the words occur.

Defined results: a null or wordless text has no words and no places; score 0 and empty labels without a match; first
and last word are null without a base place; repeated rows scan alike; an empty table gives an empty
result. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns, alnum_words

ANCHORS = 6


@dataclass(frozen=True)
class Template:
    """A licence text, the phrases that must be there, the share of votes a start needs, and by how many words a
    phrase may lie off its place (texts get a word more or less when they are filled in)."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 1.0
    base: bool = False
    slack: int = 0


#: Phrases of the base and wordings of public licences.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
TEMPLATES = BASE + (
    Template("Apache-2.0", "licensed under the apache license version 2.0", ("apache license version 2.0",), 0.6),
    Template("GPL-3.0", "licensed under the gnu general public license version 3",
             ("gnu general public license version 3",), 0.6),
    Template("GPL-2.0", "licensed under the gnu general public license version 2",
             ("gnu general public license version 2",), 0.6),
    Template("CC-BY-NC-4.0", "licensed under cc by-nc 4.0", ("cc by-nc 4.0",), 0.6),
    Template("MIT", "released under the mit license", ("under the mit license",), 0.6),
    Template(
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software",
        ("permission is hereby granted free of charge", "without restriction"), 0.5,
    ),
    Template(
        "BSD",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms with or without modification",), 0.5,
    ),
    Template(
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",), 0.5,
    ),
    Template(
        "MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0",
        ("mozilla public license v 2.0",), 0.5,
    ),
    *(
        Template(
            f"GPL-{n}.0",
            "is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            f"published by the free software foundation either version {n} of the license or at your option any later version",
            ("terms of the gnu general public license as published by", f"version {n} of the license"), 0.5,
        ) for n in (2, 3)
    ),
    Template(
        "CC-BY-NC-4.0", "licensed under a creative commons attribution noncommercial 4.0 international license",
        ("creative commons attribution noncommercial 4.0 international",), 0.6,
    ),
)

#: Headings, headers and clauses of public licences (label, text, mandatory key phrases).
_CLAUSES = (
    ("Apache-2.0", "apache license version 2.0 january 2004", ()),
    ("Apache-2.0",
     "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by "
     "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied",
     ("except in compliance with the license", "without warranties or conditions of any kind")),
    ("Apache-2.0",
     "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide "
     "non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of "
     "publicly display publicly perform sublicense and distribute the work and such derivative works in source or "
     "object form", ("each contributor hereby grants to you a perpetual worldwide", "prepare derivative works of")),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", ()),
    ("GPL-2.0", "gnu general public license version 2 june 1991", ()),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007", ()),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999", ()),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007", ()),
    ("GPL-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", ()),
    ("GPL-2.0",
     "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu "
     "general public license is intended to guarantee your freedom to share and change free software",
     ("licenses for most software are designed to take away your freedom", "intended to guarantee your freedom")),
    ("MPL-2.0", "mozilla public license version 2.0", ()),
    ("MIT",
     "the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
     "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
     "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
     ("fitness for a particular purpose and noninfringement", "shall the authors or copyright holders be liable")),
    ("BSD",
     "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
     "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
     "disclaimed", ("by the copyright holders and contributors as is", "for a particular purpose are disclaimed")),
    ("BSD-3-Clause",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission",
     ("may be used to endorse or promote products derived from this software", "specific prior written permission")),
    ("ISC",
     "the software is provided as is and the author disclaims all warranties with regard to this software including all "
     "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
     "indirect or consequential damages",
     ("the author disclaims all warranties with regard to this software", "in no event shall the author be liable")),
    ("Zlib",
     "this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software",
     ("without any express or implied warranty", "will the authors be held liable for any damages arising")),
    ("Unlicense", "this is free and unencumbered software released into the public domain", ()),
    ("BSL-1.0", "boost software license version 1.0", ()),
    ("EPL-2.0", "eclipse public license v 2.0", ()),
    ("EPL-2.0", "eclipse public license version 2.0", ()),
    ("OFL-1.1", "sil open font license version 1.1", ()),
    ("CC0-1.0", "cc0 1.0 universal", ()),
)
#: Families whose notice of free software names a version, and words of the Creative Commons licences.
_FREE = (("LGPL", "lesser general public license", ("2.1", "3")), ("AGPL", "affero general public license", ("3",)))
_COMMONS = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
_COMMONS_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_COMMONS_VERSIONS = (("4.0", "international"), ("3.0", "unported"))
#: Identifiers that a file names after "SPDX-License-Identifier".
_IDENTIFIERS = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES += tuple(
    Template(label, text, keys, 0.5 if keys else 1.0, slack=4 if keys else 0) for label, text, keys in _CLAUSES
) + tuple(
    Template(
        f"{family}-{version if '.' in version else version + '.0'}",
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the "
        f"free software foundation either version {version} of the license or at your option any later version",
        (f"gnu {name} as published by", f"version {version} of the license"), 0.5, slack=4,
    ) for family, name, versions in _FREE for version in versions
) + tuple(
    Template(f"CC-{kind.upper()}-{version}", phrase)
    for kind in _COMMONS_KINDS for version, scope in _COMMONS_VERSIONS
    for phrase in (f"cc {kind} {version}",
                   f"creative commons {' '.join(_COMMONS[word] for word in kind.split('-'))} {version} {scope}")
) + tuple(Template(name, f"spdx license identifier {name.lower()}") for name in _IDENTIFIERS)


@dataclass
class _Entry:
    template: Template
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]
    anchors: list[tuple[bytes, int]] = field(default_factory=list)
    need: int = 1


class LicenseIndex:
    """Positional index of the templates, with word weights."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], anchors: int = ANCHORS):
        self.entries, self.vocabulary = [], set()
        self.lead: dict[bytes, list[_Entry]] = {}
        for template in templates:
            words = alnum_words(template.text.encode())
            keys = [self._place(words, alnum_words(k.encode())) for k in template.keys] or [(0, words)]
            entry = _Entry(template, words, keys)
            inside = {at + k for at, key in keys for k in range(len(key))}
            order = sorted(inside, key=lambda at: (-idf.get(words[at], 0.0), at))
            chosen = order if template.base else order[:anchors]
            entry.anchors = [(words[at], at) for at in chosen]
            entry.need = max(1, math.ceil(template.share * len(entry.anchors)))
            self.entries.append(entry)
            # no place is verified without every word of the keys
            lead = min({w for _, key in keys for w in key}, key=lambda w: (-idf.get(w, 0.0), w))
            self.vocabulary |= {w for w, _ in entry.anchors} | {lead}
            self.lead.setdefault(lead, []).append(entry)
        self.rarest_first = sorted(self.lead, key=lambda w: (-idf.get(w, 0.0), w))

    @staticmethod
    def _place(words: list[bytes], key: list[bytes]) -> tuple[int, list[bytes]]:
        for at in range(len(words) - len(key) + 1):
            if words[at:at + len(key)] == key:
                return at, key
        raise ValueError(f"key phrase {key} is not part of its template")

    @staticmethod
    def _stands(words: list[bytes], at: int, key: list[bytes], slack: int) -> bool:
        return any(words[k:k + len(key)] == key for k in range(max(0, at - slack), at + slack + 1) if k >= 0)

    @staticmethod
    def _matched(words: list[bytes], start: int, own: list[bytes]) -> float:
        here = words[max(0, start):max(0, start + len(own))]
        return sum(map(bytes.__eq__, here, own[max(0, -start):])) / len(own)

    def places(self, words: list[bytes]) -> list[tuple[Template, int, float]]:
        """(template, start, share of the template's words that stand at their place) of every verified place."""
        here = self.vocabulary.intersection(words)
        leads = [w for w in self.rarest_first if w in here]
        if not leads:
            return []
        where: dict[bytes, list[int]] = {}
        for at, word in enumerate(words):
            if word in here:
                where.setdefault(word, []).append(at)
        found = []
        for lead in leads:
            for entry in self.lead[lead]:
                votes = Counter(
                    at - place for word, place in entry.anchors for at in where.get(word, ())
                )
                slack = entry.template.slack
                for start, n in votes.items():
                    if n >= entry.need and all(
                        start + at + slack >= 0 and self._stands(words, start + at, key, slack) for at, key in entry.keys
                    ):
                        found.append((entry.template, start, self._matched(words, start, entry.words)))
        return found


def template_words(templates: tuple[Template, ...] = TEMPLATES) -> list[bytes]:
    return sorted({w for t in templates for w in alnum_words(t.text.encode())})


def learn_idf(
    docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> dict[bytes, float]:
    """Inverse document frequency of the template words over all rows; a row per template word comes back."""
    vocabulary = frozenset(template_words(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen[b""] += 1
                if body:
                    seen.update(vocabulary.intersection(alnum_words(body)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    counts = docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")
    )
    rows = {bytes(r["word"]): r["n"] for r in counts.collect()}
    total = rows.pop(b"", 0)
    return {w: math.log((total + 1) / (rows.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(
    docs: DataFrame, idf: dict[bytes, float] | None = None, text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """``docs`` with word count, places of base phrases, labels, matches (label, start word) and score."""
    weights = learn_idf(docs, text, templates) if idf is None else idf

    def make():
        index = LicenseIndex(templates, weights)

        def one(texts):
            out = [[] for _ in range(8)]
            for body in texts:
                words = alnum_words(body or b"")
                found = index.places(words)
                base = [start for t, start, _ in found if t.base]
                row = (
                    len(words), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({t.label for t, _, _ in found if t.base})),
                    ",".join(sorted({t.label for t, _, _ in found})),
                    max((share for _, _, share in found), default=0.0),
                    [{"label": t.label, "start": start} for t, start, _ in sorted(found, key=lambda f: (f[1], f[0].label))],
                )
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return one

    return add_columns(
        docs, [text],
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,"
        " score double, matches array<struct<label: string, start: bigint>>", make,
    )
