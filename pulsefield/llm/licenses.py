"""License scans: known licence sentences by identifier, then ordered rules over the identifiers.

A text is cut into sentences at blank lines and sentence marks. A single line end is white space, so a
wrapped sentence is whole, but a known sentence may begin at any line's begin and end at any line's end.
Each is normalised and looked up among the known sentences (a fixed table of a few dozen patterns). What
remains per text is a short sequence of identifiers
in reading order; a rule is an ordered list of identifiers, and it fires where its list occurs as a
subsequence whose neighbours lie at most `MAX_GAP` sentences apart. A rule whose list is contained, in
order, in that of another rule that fires from the same sentence is dropped, so a BSD text of three
clauses is not one of two as well.

All of it is one projection: no shuffle, no explode, no user function.

Defined cases: very long texts are read whole; null and empty texts have no sentences and no licence; repeated rows are scanned one by
one; an empty table gives an empty result; other columns pass through (those named like a result are
replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import set_aside

#: Most sentences between two neighbours of a rule's list.
MAX_GAP = 3

#: Fixed values: (identifier, pattern of the normalised sentence). Wording of public licence texts.
_UNDER = r"^((this|all|the) \w+ is |also )*(released|licensed|distributed) under (a |the )?(terms of the )?"
_NO_MORE = r"\b(?! (nc|nd|sa|non ?commercial|no ?deriv\w*|share ?alike)\b)"
_TAG = r"(spdx )?license( identifier)? "
SENTENCES = (
    ("apache2-licensed", _UNDER + r"apache( software)? license( the license)?( version)? 2(?! [1-9]\b)\b"),
    ("apache2-compliance", r"^you may not use this (file|work|software) except in compliance with the license$"),
    ("apache2-copy", r"^you may obtain a copy of the license at https? www apache org licenses license 2 0( txt)?$"),
    ("apache2-asis", r"^unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*$"),
    ("mit-licensed", _UNDER + r"mit license\b"),
    ("mit-grant", r"^permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*$"),
    ("mit-notice", r"^the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software$"),
    ("mit-asis", r"^the software is provided as is without warranty of any kind express or implied.*$"),
    ("isc-grant", r"^permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted.*$"),
    ("isc-asis", r"^the software is provided as is and the authors? disclaims? all warranties.*$"),
    ("bsd-licensed", _UNDER + r"(new |modified |simplified |[234] clause )?bsd( [234] clause)? license\b"),
    ("bsd-redistribution", r"^redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met\b"),
    ("bsd-endorse", r"^neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software.*$"),
    ("bsd-asis", r"^this software is provided by the copyright holders and contributors as is and any express or implied warranties.*$"),
    ("gpl2-licensed", _UNDER + r"gnu general public license (version|v) ?2(?! [1-9]\b)\b"),
    ("gpl3-licensed", _UNDER + r"gnu general public license (version|v) ?3(?! [1-9]\b)\b"),
    ("lgpl-licensed", _UNDER + r"gnu lesser general public license.*$"),
    ("agpl-licensed", _UNDER + r"gnu affero general public license.*$"),
    ("gpl-free", r"^this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*$"),
    ("gpl-hope", r"^this program is distributed in the hope that it will be useful but without any warranty.*$"),
    ("mpl2-subject", r"^this source code form is subject to the terms of the mozilla public license v 2 0$"),
    ("ccby-licensed", _UNDER + r"(creative commons attribution|cc by)" + _NO_MORE),
    ("ccbysa-licensed", _UNDER + r"(creative commons attribution sharealike|cc by sa)" + _NO_MORE),
    ("ccbync-licensed", _UNDER + r"(creative commons attribution noncommercial|cc by nc)" + _NO_MORE),
    ("ccbyncnd-licensed", _UNDER + r"(creative commons attribution noncommercial noderivatives|cc by nc nd)" + _NO_MORE),
    ("cc0-dedicated", _UNDER + r"(creative commons zero|cc0).*$"),
    ("unlicense-domain", r"^this is free and unencumbered software released into the public domain$"),
    ("rights-reserved", r"^(copyright .* )?all rights reserved$"),
    ("lgpl-free", r"^this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation.*$"),
    ("lgpl-hope", r"^this library is distributed in the hope that it will be useful but without any warranty.*$"),
    ("boost-grant", r"^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*$"),
    ("boost-licensed", _UNDER + r"boost software license\b"),
    ("epl2-licensed", _UNDER + r"eclipse public license( version| v)? ?2(?! [1-9]\b)\b"),
    ("eupl-licensed", _UNDER + r"(eupl|european union public licen[sc]e)\b"),
    ("ccbynd-licensed", _UNDER + r"(creative commons attribution noderivatives|cc by nd)" + _NO_MORE),
    ("mit-tag", r"^(" + _TAG + r"mit|(the )?mit license)$"),
    ("apache2-tag", r"^(" + _TAG + r"apache( license)?( version)? 2( 0)?|apache license( version 2 0)?)$"),
    ("isc-tag", r"^(" + _TAG + r"isc|isc license)$"),
    ("bsd2-tag", r"^(" + _TAG + r"|)(bsd 2 clause|2 clause bsd)( license)?$"),
    ("bsd3-tag", r"^(" + _TAG + r"|)(bsd 3 clause|3 clause bsd)( license)?$"),
    ("gpl2-tag", r"^" + _TAG + r"gpl v?2( 0)?( only| or later)?$"),
    ("gpl3-tag", r"^" + _TAG + r"gpl v?3( 0)?( only| or later)?$"),
    ("lgpl-tag", r"^(" + _TAG + r"lgpl( v?[23]( [01])?)?( only| or later)?|gnu lesser general public license)$"),
    ("agpl-tag", r"^(" + _TAG + r"agpl( v?3( 0)?)?( only| or later)?|gnu affero general public license)$"),
    ("mpl2-tag", r"^(" + _TAG + r"mpl 2 0|mozilla public license( version 2 0)?)$"),
    ("boost-tag", r"^(" + _TAG + r"bsl 1 0|boost software license( version 1 0)?)$"),
    ("epl2-tag", r"^(" + _TAG + r"epl 2 0|eclipse public license( version| v)? 2 0)$"),
    ("eupl-tag", r"^(" + _TAG + r"|)eupl( v?1 [12])?$"),
    ("ccby-tag", r"^" + _TAG + r"cc by( [0-9] [0-9])?$"),
    ("ccbysa-tag", r"^" + _TAG + r"cc by sa( [0-9] [0-9])?$"),
    ("ccbynd-tag", r"^" + _TAG + r"cc by nd( [0-9] [0-9])?$"),
    ("cc0-tag", r"^" + _TAG + r"cc0( 1 0)?$"),
)

#: Fixed values: (licence, identifiers in order), the more specific rules first.
RULES = (
    ("Apache-2.0", ("apache2-licensed", "apache2-compliance", "apache2-copy", "apache2-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-asis")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant", "mit-asis")),
    ("GPL", ("gpl-free", "gpl-hope")),
    ("LGPL", ("lgpl-free", "lgpl-hope")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("BSD", ("bsd-licensed",)),
    ("GPL-2.0", ("gpl2-licensed",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("LGPL", ("lgpl-licensed",)),
    ("AGPL", ("agpl-licensed",)),
    ("GPL", ("gpl-free",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("CC-BY", ("ccby-licensed",)),
    ("CC-BY-SA", ("ccbysa-licensed",)),
    ("CC-BY-NC", ("ccbync-licensed",)),
    ("CC-BY-NC-ND", ("ccbyncnd-licensed",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("Unlicense", ("unlicense-domain",)),
    ("All-Rights-Reserved", ("rights-reserved",)),
    ("LGPL", ("lgpl-free",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-licensed",)),
    ("EPL-2.0", ("epl2-licensed",)),
    ("EUPL", ("eupl-licensed",)),
    ("CC-BY-ND", ("ccbynd-licensed",)),
    ("MIT", ("mit-tag",)),
    ("Apache-2.0", ("apache2-tag",)),
    ("ISC", ("isc-tag",)),
    ("BSD-2-Clause", ("bsd2-tag",)),
    ("BSD-3-Clause", ("bsd3-tag",)),
    ("GPL-2.0", ("gpl2-tag",)),
    ("GPL-3.0", ("gpl3-tag",)),
    ("LGPL", ("lgpl-tag",)),
    ("AGPL", ("agpl-tag",)),
    ("MPL-2.0", ("mpl2-tag",)),
    ("BSL-1.0", ("boost-tag",)),
    ("EPL-2.0", ("epl2-tag",)),
    ("EUPL", ("eupl-tag",)),
    ("CC-BY", ("ccby-tag",)),
    ("CC-BY-SA", ("ccbysa-tag",)),
    ("CC-BY-ND", ("ccbynd-tag",)),
    ("CC0-1.0", ("cc0-tag",)),
)
#: Words of which every known sentence has at least one; only sentences with one are normalised.
TRIGGER = r"(?i)licen[sc]|permi|warrant|redistribut|endorse|copyright|public\W+domain|creative\W+commons|\bcc\W+by|compliance|as\W+is|\bcc0\b|free\W+software|rights\W+reserved|hope\W+that|\beupl\b|\bbsd\b"
#: Words with which every known sentence begins.
START = r"^(released|licensed|distributed|this|all|the|also|you may|unless|permission|redistribution|neither|copyright|spdx|license|mit|apache|isc|bsd|[23] clause|gnu|mozilla|boost|eclipse|eupl)\b"
#: Words of the longest known sentence of a fixed number of words, and more; a line has a word at least, so none takes more lines.
REACH = 100
#: A sentence ends at . ! ? ; before white space (a dot inside 2.0 or before it, as in "v. 2.0", ends nothing, nor does the mark in "free software; you can").
_MARK = r"(?<=[.!?;])(?<!(?i:free\W{1,8}software;))(?!(?<=\b[vV]\.)\W{1,8}[0-9])[\x20\x09-\x0D]+"
#: And at a line without letters and digits (blank, or only comment marks), unless an address follows.
TEXT_END = r"\n[^\p{L}\p{N}\n]*+\n(?!\W{0,80}https?://)|" + _MARK
#: The ends of sentences where each keeps to one line.
SENTENCE_END = r"\n+|" + _MARK


def normalised(sentence: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _lines(sentence: Column) -> Column:
    """The normalised lines of a sentence that have a word, without comment words."""
    lines = F.transform(F.split(sentence, r"\n"), lambda x: F.regexp_replace(normalised(x), r"^(dnl|rem)( |$)", ""))
    return F.filter(lines, lambda x: x != "")


def identifier(lines: Column) -> Column:
    """The first known sentence that begins the lines (joined by line ends) and the line ends in it, or null."""
    key = F.lit(None).cast("struct<sentence_id:string,more:int>")
    for name, pattern in reversed(SENTENCES):
        wrapped = "(?m)" + pattern.replace("^", r"\A", 1).replace(".* nor", r"[\s\S]* nor").replace(" ", r"[ \n]")
        hit = F.regexp_extract(lines, wrapped, 0)
        more = (F.length(hit) - F.length(F.replace(hit, F.lit("\n"), F.lit("")))).cast("int")
        key = F.when(lines.rlike(wrapped), F.struct(F.lit(name).alias("sentence_id"), more.alias("more"))).otherwise(key)
    return key


def known_sentences(text: Column) -> Column:
    """array<struct<place, sentence_id>> of a text, in reading order; place counts all its sentences from 0.

    What has no two letters in a row, such as the number of a list item, does not count as a sentence.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), TEXT_END), lambda s: s.rlike(r"(?<![\p{L}\p{N}])(?!(?i:dnl|rem)[^\p{L}])\p{L}{2}"))
    placed = F.transform(parts, lambda s, i: F.struct(i.alias("place"), s.alias("sentence")))
    asked = F.filter(placed, lambda p: p["sentence"].rlike(TRIGGER))
    cut = F.transform(asked, lambda p: F.struct(p["place"].alias("place"), _lines(p["sentence"]).alias("lines")))

    def named(p: Column) -> Column:
        # All of the sentence's lines for the one pattern that may run over any number of them.
        reach = lambda x: F.when(x.rlike(r"^neither\b"), F.size(p["lines"])).otherwise(REACH)
        at = lambda x, k: F.transform(F.array(F.concat_ws("\n", F.slice(p["lines"], k + 1, reach(x)))), identifier)[0]
        return F.transform(p["lines"], lambda x, k: F.struct(p["place"].alias("place"), k.alias("line"), F.when(x.rlike(START), at(x, k)).alias("hit")))

    hits = F.filter(F.flatten(F.transform(cut, named)), lambda h: h["hit"].isNotNull())

    def apart(hs: Column) -> Column:
        """Without those inside the one before ("this work is" / "licensed under ..." on two lines)."""
        before = lambda i: F.get(hs, i - 1)
        inside = lambda h, i: (before(i)["place"] == h["place"]) & (before(i)["line"] + before(i)["hit"]["more"] >= h["line"])
        own = F.filter(hs, lambda h, i: ~F.coalesce(inside(h, i), F.lit(False)))
        return F.transform(own, lambda h: F.struct(h["place"].alias("place"), h["hit"]["sentence_id"].alias("sentence_id")))

    none = F.array().cast("array<struct<place:int,sentence_id:string>>")
    return F.when(text.rlike(TRIGGER), F.transform(F.array(hits), apart)[0]).otherwise(none)


def _fires(seq: Column, ids: tuple[str, ...]) -> Column:
    """Place of the first sentence of the earliest full match, or null. seq: array<struct<place, sentence_id>>."""
    n = len(ids)
    none = F.lit(None).cast("int")
    empty = F.struct(*[none.alias(f"p{k}") for k in range(n)], *[none.alias(f"s{k}") for k in range(n)], none.alias("hit"))

    def step(a: Column, e: Column) -> Column:
        # p_k: place of the last sentence that ends a match of the first k + 1 identifiers; s_k: where it began.
        at, key = e["place"], e["sentence_id"]
        on = [key == ids[0]] + [(key == ids[k]) & a[f"p{k - 1}"].isNotNull() & (at - a[f"p{k - 1}"] <= MAX_GAP + 1) for k in range(1, n)]
        began = [at] + [a[f"s{k - 1}"] for k in range(1, n)]
        p = [F.when(on[k], at).otherwise(a[f"p{k}"]) for k in range(n)]
        s = [F.when(on[k], began[k]).otherwise(a[f"s{k}"]) for k in range(n)]
        hit = F.coalesce(a["hit"], F.when(on[n - 1], began[n - 1]))
        return F.struct(*[p[k].alias(f"p{k}") for k in range(n)], *[s[k].alias(f"s{k}") for k in range(n)], hit.alias("hit"))

    return F.aggregate(seq, empty, step)["hit"]


def _inside(k: int) -> list[int]:
    """The rules whose identifiers contain those of rule k, in order, from the first one on."""
    ids = RULES[k][1]

    def contains(other: tuple[str, ...]) -> bool:
        rest = iter(other)
        return other[0] == ids[0] and len(other) > len(ids) and all(x in rest for x in ids)

    return [o for o, (_, other) in enumerate(RULES) if contains(other)]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with sentence_ids, licenses (in rule order, distinct) and spans (licence, rule, first place)."""
    docs, back = set_aside(docs, ("_seq", "_fired"))
    hits = [F.struct(F.lit(licence).alias("license"), F.lit(k).alias("rule"), _fires(F.col("_seq"), ids).alias("place")) for k, (licence, ids) in enumerate(RULES)]
    fired = F.when(F.size("_seq") > 0, F.filter(F.array(*hits), lambda h: h["place"].isNotNull())).otherwise(F.array().cast("array<struct<license:string,rule:int,place:int>>"))
    # A rule goes where one that contains it begins at the same sentence, or a former one of its licence does.
    said = F.filter("_fired", lambda h: ~F.exists("_fired", lambda o: (o["place"] == h["place"]) & _drops(o, h)))
    found = docs.withColumn("_seq", known_sentences(F.col(text))).withColumn("_fired", fired).withColumn("spans", said)
    return found.withColumns(
        {
            "sentence_ids": F.transform("_seq", lambda e: e["sentence_id"]),
            "licenses": F.array_distinct(F.transform("spans", lambda h: h["license"])),
        }
    ).drop("_seq", "_fired").withColumnsRenamed(back)


def _drops(o: Column, h: Column) -> Column:
    """Whether rule o, where both begin at one sentence, makes rule h say nothing new."""
    contained = [(h["rule"] == k) & o["rule"].isin(_inside(k)) for k in range(len(RULES)) if _inside(k)]
    return reduce(lambda a, b: a | b, contained, (o["license"] == h["license"]) & (o["rule"] < h["rule"]))
