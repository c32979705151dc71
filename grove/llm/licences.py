"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences meet ordered rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import slices, table

#: Known sentences in normal form (a-z and 0-9, single spaces), under their identifiers.
SENTENCES = {
    "apache2.notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0"],
    "apache2.compliance": ["you may not use this file except in compliance with the license"],
    "apache2.copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache2.asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit.notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license"],
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.retain": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3.notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is licensed under the gnu general public license version 3"],
    "gpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl21.free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3.free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl.hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl.hope": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.copy": ["you should have received a copy of the gnu general public license along with this program"],
    "ccbync4.notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccby4.notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa4.notice": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0.notice": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "mpl2.notice": ["this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2 0", "licensed under the mozilla public license 2 0"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.notice": ["licensed under the isc license", "released under the isc license"],
    "unlicense.notice": ["this is free and unencumbered software released into the public domain"],
    "unlicense.grant": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "boost.grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "boost.notice": ["distributed under the boost software license version 1 0"],
    "zlib.asis": ["this software is provided as is without any express or implied warranty"],
    "zlib.held": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib.permit": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "epl2.notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v"],
    "bsd.permit": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
}
#: Ordered rules: a licence and its consecutive identifiers. At each place of a sequence the first rule that fits takes its
#: identifiers, so longer and stronger rules stand before those that begin alike.
RULES = [
    ("Apache-2.0", ["apache2.notice", "apache2.compliance", "apache2.copy", "apache2.asis"]),
    ("Apache-2.0", ["apache2.compliance", "apache2.copy"]),
    ("Apache-2.0", ["apache2.notice"]),
    ("MIT", ["mit.notice"]),
    ("MIT", ["mit.grant", "mit.retain"]),
    ("GPL-3.0-only", ["gpl3.notice"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.hope"]),
    ("GPL-2.0-or-later", ["gpl2.free", "gpl.hope"]),
    ("LGPL-2.1-or-later", ["lgpl21.free", "lgpl.hope"]),
    ("LGPL-3.0-or-later", ["lgpl3.free", "lgpl.hope"]),
    ("AGPL-3.0-or-later", ["agpl3.free", "gpl.hope"]),
    ("CC-BY-NC-4.0", ["ccbync4.notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4.notice"]),
    ("CC-BY-4.0", ["ccby4.notice"]),
    ("CC0-1.0", ["cc0.notice"]),
    ("MPL-2.0", ["mpl2.notice"]),
    ("ISC", ["isc.grant"]),
    ("ISC", ["isc.notice"]),
    ("Unlicense", ["unlicense.notice", "unlicense.grant"]),
    ("Unlicense", ["unlicense.notice"]),
    ("BSL-1.0", ["boost.grant"]),
    ("BSL-1.0", ["boost.notice"]),
    ("Zlib", ["zlib.asis", "zlib.held", "zlib.permit"]),
    ("EPL-2.0", ["epl2.notice"]),
    ("BSD-3-Clause", ["bsd.permit", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd.permit", "bsd.source", "bsd.binary"]),
]
#: Sentences end at a mark with white space behind it and at line ends, so that version numbers stay whole.
BREAK = "[.!?;:]+[ \t\r\n\f]+|[\r\n]+"
_BREAK, _OTHER, _LINE = re.compile(f"({BREAK})"), re.compile("[^a-z0-9]+"), re.compile("\r\n|\r|\n")
_LOWER = {c: c + 32 for c in range(65, 91)}
_KNOWN = {s: i for i, forms in SENTENCES.items() for s in forms}
#: The known sentences and what they begin with, cut at words.
_BEGUN = {s[:at] for s in _KNOWN for at in [*(m.start() for m in re.finditer(" ", s)), len(s)]}


def _open(mark: str) -> bool:
    """A single line end, semicolon or colon, behind which a known sentence may go on."""
    return not set(mark) & set(".!?") and len(_LINE.findall(mark)) <= 1


def identifiers(text: str | None) -> list[str]:
    """The identifiers of the known sentences of a text, in order; other sentences are passed over.

    Wrapped sentences count: where pieces begin a known sentence they are joined over single line ends, semicolons and
    colons, never over blank lines or full stops, and the longest known sentence is taken. Comment signs are no letters.
    """
    out, at = [], 0
    cut = _BREAK.split((text or "").translate(_LOWER) + "\n")
    while at < len(cut):
        sentence, end = _OTHER.sub(" ", cut[at]).strip(), at
        found, after = None, at + 2
        while sentence in _BEGUN:
            if sentence in _KNOWN:
                found, after = _KNOWN[sentence], end + 2
            if end + 2 >= len(cut) or not _open(cut[end + 1]) or not (more := _OTHER.sub(" ", cut[end + 2]).strip()):
                break
            sentence, end = f"{sentence} {more}", end + 2
        if found:
            out.append(found)
        at = after
    return out


def _line(rule: list[str]) -> str:
    return "".join(f"|{i}|" for i in rule)


_RULE = re.compile("|".join(re.escape(_line(rule)) for _, rule in RULES))
_NAMED = {_line(rule): name for name, rule in RULES}


def licences(found: list[str]) -> list[str]:
    """The licences of the rules that the sequence is read as: from the left, the first rule in order that fits at a place
    takes its identifiers, without a gap; an identifier that begins no rule is passed over."""
    return sorted({_NAMED[hit] for hit in _RULE.findall(_line(found))})


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences (both joined, in order and sorted) for every row of docs.

    Whole texts. Null and empty texts, like texts without a known sentence: 0 and empty strings. Rows are independent:
    repeats get equal answers, an empty table none. Other columns of docs are not read.
    """

    def run(batches):
        for batch in slices(batches):
            found = [identifiers(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([" ".join(f) for f in found], pa.string()), pa.array([",".join(licences(f)) for f in found], pa.string())], ["doc_id", "n_sentences", "sentence_ids", "licences"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_sentences long, sentence_ids string, licences string")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in _KNOWN.items())
    rules = ", ".join(f"('{line}', '{name}')" for line, name in _NAMED.items())
    either = "|".join("".join(rf"\|{i.replace('.', '[.]')}\|" for i in rule) for _, rule in RULES)
    return rf"""
WITH known(sentence, id) AS (VALUES {values}), rules(line, licence) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(10), '[.!?;:]+[ \t\r\n\f]+|[\r\n]+') AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM cut),
found AS (SELECT e.doc_id, e.pos, k.id FROM (SELECT doc_id, pos, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM each) e JOIN known k USING (sentence)),
line AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY pos) AS ids, string_agg('|' || id || '|', '' ORDER BY pos) AS line FROM found GROUP BY doc_id),
hit AS (SELECT doc_id, unnest(regexp_extract_all(line, '{either}')) AS line FROM line),
kept AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM hit JOIN rules USING (line) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n, 0) AS n_sentences, coalesce(l.ids, '') AS sentence_ids, coalesce(k.licences, '') AS licences
FROM documents d LEFT JOIN line l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


SQL = {"op1_licences": _sql()}
