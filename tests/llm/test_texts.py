import hashlib
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsefield.llm import chat, fingerprints, licenses, mixing, packing, quality_rules


def test_quality_rules_on_odd_rows(odd, none, rows):
    got = quality_rules.apply_rules(odd).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_words == by_id[3].n_words == by_id[4].n_words == 0 and by_id[2].base_failed and not by_id[2].kept
    assert by_id[8].n_words == by_id[8].n_repeat_words == 23 and by_id[8].base_failed
    assert by_id[11].n_repeat_words == 120
    assert by_id[9].n_symbols == len("###$$$||***<>%%%")
    assert quality_rules.apply_rules(none).count() == 0
    assert quality_rules.kept_documents(odd).columns == odd.columns
    assert quality_rules.kept_documents(odd).count() == sum(r.kept for r in got)


def test_repeated_words_equal_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(df).collect()}
    for i, t, _ in corpus:
        w = t.encode().split()
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {x for ks in seen.values() if len(ks) > 1 for k in ks for x in range(k, k + 8)}
        assert got[i] == len(covered)


def test_license_rules(spark, odd, none):
    apache = (
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES."
    )
    texts = [apache, "Code here. Released under the MIT License. Also licensed under CC BY-NC 4.0.", "The license of the driver.", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[0].licenses == ["Apache-2.0"] and len(got[0].sentence_ids) == 4 and len(got[0].spans) == 1
    assert got[1].licenses == ["MIT", "CC-BY-NC"] and got[2].licenses == [] and got[3].licenses == ["GPL-3.0"]
    assert all(r.licenses == [] for r in licenses.scan(odd).collect())
    assert licenses.scan(none).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice in the documentation.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
ISC = """Copyright (c) 2020 A. Writer
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that this notice appears in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."""
WHOLE = (
    (MIT, "MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    (BSD, "BSD-3-Clause", ["bsd-redistribution", "bsd-endorse", "bsd-asis"]),
    (BSD.replace(BSD[BSD.index("3. ") : BSD.index("\nTHIS")], ""), "BSD-2-Clause", ["bsd-redistribution", "bsd-asis"]),
    (ISC, "ISC", ["isc-grant", "isc-asis"]),
    (GPL, "GPL", ["gpl-free", "gpl-hope"]),
    (APACHE, "Apache-2.0", ["apache2-licensed", "apache2-compliance", "apache2-copy", "apache2-asis"]),
)


@pytest.mark.parametrize(("width", "mark", "end"), [(0, "", "\n"), (78, "", "\n"), (40, "# ", "\n"), (30, " * ", "\r\n"), (78, "// ", "\n"), (60, "dnl ", "\n")])
def test_wrapped_licenses(spark, width, mark, end):
    wrap = lambda t: end.join(mark + x for line in t.split("\n") for x in (textwrap.wrap(line, width, break_long_words=False, break_on_hyphens=False) if width else [line]) or [""])
    df = spark.createDataFrame([(k, wrap(t)) for k, (t, _, _) in enumerate(WHOLE)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, (_, name, ids) in enumerate(WHOLE):
        assert got[k].sentence_ids == ids
        assert name in got[k].licenses
        assert licenses.RULES[got[k].spans[0].rule] == (name, tuple(ids))


def test_licence_lines_with_more_words(spark):
    texts = {
        "This project is licensed under the MIT License - see the LICENSE file for details": ["MIT"],
        "Notes\nThis work is\nlicensed under the\nMIT License\nand more words\nAll rights\nreserved": ["MIT", "All-Rights-Reserved"],
        "Licensed under CC BY-NC-ND 4.0 by the author": ["CC-BY-NC-ND"],
        "Licensed under CC BY-SA 4.0 by the author": ["CC-BY-SA"],
        "Licensed under CC BY 4.0 by the author": ["CC-BY"],
        "Licensed under CC BY-NC-SA 4.0 by the author": [],
        "Released under the Apache License 2.0 by us": ["Apache-2.0"],
        "Released under the Apache License 2.1 by us": [],
        "Released under the MIT Licenses page": [],
    }
    df = spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {t: r.licenses for t, r in got.items()} == texts
    assert all(len(r.sentence_ids) == len(r.licenses) for r in got.values())


#: A sentence for each identifier of the table, in its order.
SAMPLES = """Licensed under the Apache License, Version 2.0
you may not use this file except in compliance with the License
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS
Released under the MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
distributed under the 3-clause BSD license
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES
Licensed under the GNU General Public License version 2
Licensed under the GNU General Public License v3
Licensed under the GNU Lesser General Public License
Licensed under the GNU Affero General Public License
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0
distributed under Creative Commons Attribution 4.0 International
Released under CC BY-SA 4.0
Released under CC BY-NC 4.0
Released under CC BY-NC-ND 4.0
Released under CC0
This is free and unencumbered software released into the public domain
All rights reserved
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
Distributed under the Boost Software License, Version 1.0
Licensed under the Eclipse Public License 2.0
Licensed under the EUPL
Licensed under CC BY-ND 4.0
MIT License
SPDX-License-Identifier: Apache-2.0
License: ISC
BSD-2-Clause
SPDX-License-Identifier: BSD-3-Clause
SPDX-License-Identifier: GPL-2.0-or-later
SPDX-License-Identifier: GPL-3.0-only
GNU Lesser General Public License
License: AGPL-3.0
Mozilla Public License, version 2.0
License: BSL-1.0
License: EPL-2.0
EUPL
License: CC-BY-4.0
License: CC-BY-SA-4.0
License: CC-BY-ND-4.0
License: CC0-1.0""".split("\n")


def test_every_known_sentence_is_found(spark):
    texts = [*SAMPLES, "Released under CC BY 4.0"]
    names = [name for name, _ in licenses.SENTENCES]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [[n] for n in [*names, "ccby-licensed"]]


def brute_licenses(ids):
    """Rules over (place, identifier) in order: the earliest whole match of each, without contained ones."""
    fired = []
    for k, (name, rule) in enumerate(licenses.RULES):
        found = None
        last, begun = [None] * len(rule), [None] * len(rule)
        for place, x in ids:
            before = list(zip(last, begun, strict=True))
            for j, want in enumerate(rule):
                if x != want:
                    continue
                if j == 0:
                    last[0], begun[0] = place, place
                elif before[j - 1][0] is not None and place - before[j - 1][0] <= licenses.MAX_GAP + 1:
                    last[j], begun[j] = place, before[j - 1][1]
                else:
                    continue
                if j == len(rule) - 1 and found is None:
                    found = begun[j]
        if found is not None:
            fired.append((k, name, rule, found))

    def within(short, long):
        at = -1
        for x in short:
            if x not in long[at + 1 :]:
                return False
            at = long.index(x, at + 1)
        return True

    drop = lambda h: any(o[3] == h[3] and ((o[1] == h[1] and o[0] < h[0]) or (len(o[2]) > len(h[2]) and o[2][0] == h[2][0] and within(h[2], o[2]))) for o in fired)
    return list(dict.fromkeys(h[1] for h in fired if not drop(h)))


def test_rules_of_several_sentences_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    names = [name for name, _ in licenses.SENTENCES]
    wanted = sorted({i for _, ids in licenses.RULES if len(ids) > 1 for i in ids})
    rows, want = [], {}
    for k in range(120):
        picks = [None if rng.random() < 0.25 else wanted[rng.integers(len(wanted))] for _ in range(10)]
        if k % 2:  # a whole rule with noise between its sentences
            rule = [ids for _, ids in licenses.RULES if len(ids) > 1][k // 2 % 7]
            picks = [x for i in rule for x in [i, *[None] * int(rng.integers(0, 6))]] + picks[:3]
        rows.append((k, "\n\n".join("Plain words stand here" if p is None else SAMPLES[names.index(p)] for p in picks)))
        want[k] = brute_licenses([(j, p) for j, p in enumerate(picks) if p is not None])
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_wrapped_licence_is_one_licence(spark):
    whole = {"BSD-3-Clause": (11, 12, 13), "BSD-2-Clause": (11, 13), "MIT": (5, 6, 7), "ISC": (8, 9), "GPL": (18, 19), "MPL-2.0": (20,), "Apache-2.0": (0, 1, 2, 3)}
    rows = []
    for name, picks in whole.items():
        text = "Copyright (c) 2020 X\n\n" + "\n\n".join(textwrap.fill(SAMPLES[k] + ".", 60) for k in picks)
        rows += [(name, text), (name, "\n".join(f" * {line}".rstrip() for line in text.split("\n")))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.licenses for r in got] == [[r.doc_id] for r in got] and len(got) == 14


def test_licenses_of_the_corpus(spark, corpus):
    import regex

    df = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    single = {ids[0]: (k, name) for k, (name, ids) in reversed(list(enumerate(licenses.RULES))) if len(ids) == 1}
    found = 0
    for i, t, _ in corpus:
        seq = []
        for part in regex.split(licenses.SENTENCE_END, t):
            norm = regex.sub(r"[^\p{L}\p{N}]+", " ", part.lower()).strip()
            seq += [name for name, pattern in licenses.SENTENCES if regex.search(pattern, norm)][:1]
        assert got[i].sentence_ids == seq
        assert got[i].licenses == [name for _, name in sorted({single[x] for x in seq if x in single})]
        found += len(seq)
    assert found > 0


def brute_likeness(a, b, codes):
    x, y = ({int(v) for v in fingerprints.digests(t.encode(), codes)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_of_the_corpus(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare(df).collect()}
    order, codes = sorted(corpus, reverse=True), fingerprints.Codes()
    assert len(got) == len(corpus)
    for k, (i, t, _) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(got[i].near_edited - brute_likeness(t, new, codes)) < 1e-12
        assert abs(got[i].near_next - brute_likeness(t, following, codes)) < 1e-12
    by_text = {}
    for i, t, _ in corpus:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_of_odd_rows_and_of_none(spark, odd, none, rows):
    got = fingerprints.compare(odd).collect()
    assert len(got) == len(rows) and all(0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare(none).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_peeling_recovers_differences():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (0, 3, 40, 2000)]
    pairs = [(a, b[: len(b) // 2]) for a in sets for b in sets]
    found, took = fingerprints.differences(pairs)
    for (a, b), d in zip(pairs, found, strict=True):
        assert set(d.tolist()) == set(a.tolist()) ^ set(b.tolist())
    assert max(took) > fingerprints.CELLS


def test_pieces_are_those_of_the_tokenizer(spark, odd, rows, corpus):
    tok = packing.tokenizer()
    texts = [(r[0], r[1]) for r in rows if r[0] is not None] + [(1000 + i, t) for i, t, _ in corpus[:40]] + [(5000, "a <|endoftext|> b<|startoftext|>c İ ΑΣ x y don't 1234")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=512).collect()
    want = []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want.append((i, k // 512, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) <= -(-sum(w[3] for w in want) // 512) + 1


@pytest.mark.parametrize("first", ["\u00a0 one two three", "one one, one. one;", "one two\u3000three \u2028 four"])
def test_words_without_ids_when_the_memo_is_full(monkeypatch, first):
    monkeypatch.setattr(packing, "KEPT", 3)
    tok, encode = packing.tokenizer(), packing.encoder.__wrapped__()
    for text in (first, "four \u00a0 one, \u2028 \u3000 .", "five \u00a0 one, \u2028 \u0085 \u3000 four", "\u00a0"):
        assert encode([text.encode()]) == [np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@pytest.mark.parametrize("seed", range(5))
def test_fullest_combination(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 40), 6, replace=False), rng.integers(1, 4, 6), strict=True)}
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    used = packing.fullest(counts, 60)
    assert all(n <= counts[x] for x, n in used.items())
    assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= 60)


def test_pack_nothing(none):
    assert packing.pack(none).count() == 0


def brute_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s]]
        if not over:
            return out | level
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mix_meets_targets(spark, corpus):
    rows = [(i, s, len(t.split())) for i, t, s in corpus] + [(9000, None, 70), (9001, "", 5), (9002, "zero", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("key", F.md5(F.col("doc_id").cast("string")))
    got = mixing.mix(sized, block=512).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, taken = brute_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in want)


def test_schedule_stays_close_to_its_shares(spark):
    rows = mixing.schedule(spark, [(0, 3000), (1, 1000), (2, 2000)], 1).orderBy("slot").collect()
    assert len(rows) == 6000
    for place, share in ((0, 1 / 2), (1, 1 / 6), (2, 1 / 3)):
        slots = [r for r in rows if r.place == place]
        assert [r.block for r in slots] == list(range(len(slots)))
        n = np.cumsum([r.place == place for r in rows])
        assert abs(n - share * np.arange(1, 6001)).max() < 8


def test_mix_of_odd_rows_and_of_none(odd, none, rows):
    assert mixing.mix(mixing.sizes(odd)).count() == len(rows)
    assert mixing.mix(mixing.sizes(none)).count() == 0
    copies = mixing.taken_documents(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert copies.columns == ["doc_id", "text", "lang", "source", "n_chars"] and copies.count() > 0
    assert mixing.taken_documents(none).count() == 0


def test_the_schedule_decides_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(["w"] * 40), f"s{k % 3}") for k in range(30)], "doc_id long, text string, source string")
    blocks = {(r.place, r.block): r.slot for r in mixing.schedule(spark, [(0, 600), (1, 400), (2, 800)], 100).collect()}
    assert set(blocks) == {(p, b) for p, n in ((0, 6), (1, 4), (2, 8)) for b in range(n)}
    assert sum(r.taken for r in mixing.mix(mixing.sizes(docs), block=100).collect()) == 1800
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: whole(*a).filter("place = 1 and block < 2"))
    assert sum(r.taken for r in mixing.mix(mixing.sizes(docs), block=100).collect()) == 200
    monkeypatch.setattr(mixing, "schedule", lambda *a: whole(*a).limit(0))
    assert sum(r.taken for r in mixing.mix(mixing.sizes(docs), block=100).collect()) == 0


def test_mixed_documents_follow_the_slots_and_keep_their_columns(spark):
    rows = [(k, f"{k} " + " ".join(["w"] * 399), f"s{k % 3}", 777, k) for k in range(300)] + [(None, "a b c", "s1", 1, 2)] * 2 + [(-1, "d e", "s1", 3, 4), (5, None, "s0", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long, slot long")
    out = mixing.taken_documents(docs)
    got = out.collect()
    assert out.columns == docs.columns and {r.copy for r in got} <= {777, 1, 3}
    taken = {}
    for r in mixing.mix(mixing.sizes(docs)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = {}
    for r in got:
        assert r.slot == (r.doc_id if r.copy == 777 else r.slot)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}
    # Eleven blocks: each half of the mix holds every source.
    half = len(got) // 2
    assert {r.source for r in got[:half]} == {r.source for r in got[half:]} == {"s0", "s1", "s2"}


def brute_conversation(rows):
    """position, parent, n_quotes, n_linked of each (turn, text) of a conversation whose turns are all different."""
    units, parents, linked, quotes = {}, {}, {}, {}
    turns = sorted(t for t, _ in rows)
    for turn, text in rows:
        units[turn] = {(level, n) for level, p in chat.parsed(text or "")[1] if (n := chat.normalised(p))}
    for k, turn in enumerate(turns):
        votes = {}
        for level, passage in units[turn]:
            earlier = [t for t in turns[:k] if (0, passage) in units[t]]
            if level and earlier:
                votes.setdefault(earlier[-1], []).append((level, len(passage)))
        best = max(((-min(x for x, _ in v), sum(n for _, n in v), t) for t, v in votes.items()), default=None)
        parents[turn] = best[2] if best else turns[k - 1] if k else None
        linked[turn] = sum(map(len, votes.values()))
        quotes[turn] = sum(level > 0 for level, _ in units[turn])
    run = {}
    for k, turn in enumerate(turns):
        run[turn] = run[turns[k - 1]] if k and parents[turn] == turns[k - 1] else turn
    order = []

    def write(start):
        mine = [t for t in turns if run[t] == start]
        order.extend(mine)
        heads = [t for t in turns if run[t] == t and t != start and parents[t] in mine]
        for head in sorted(heads, key=lambda t: (-parents[t], t)):
            write(head)

    if turns:
        write(turns[0])
    return {t: (order.index(t), parents[t], quotes[t], linked[t]) for t in turns}


def test_conversations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 4)  # many blocks
    rng, rows, want = np.random.default_rng(2), [], {}
    for conv in range(40):
        texts = []
        for turn in range(int(rng.integers(1, 16))):
            lines = [f"own words {rng.integers(0, 4 if conv % 3 == 0 else 400)} of turn", f"second line {turn}"][: int(rng.integers(1, 3))]
            for _ in range(int(rng.integers(0, 3)) if texts else 0):
                quoted = texts[int(rng.integers(len(texts)))].split("\n")
                lines = ["> " + q for q in quoted[: int(rng.integers(1, 4))]] + ["", *lines]
            texts.append("\n".join(lines))
        numbered = [(3 * k - 5, t) for k, t in enumerate(texts)]
        rows += [(conv, turn, "u", t) for turn, t in numbered]
        want |= {(conv, turn): w for turn, w in brute_conversation(numbered).items()}
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.position, r.parent_turn, r.n_quotes, r.n_linked) for r in got} == want
    assert all(not line.startswith(">") for r in got for line in r.text.split("\n"))
    assert sum(w[3] > 0 for w in want.values()) > 50


def test_quotes_are_linked_and_dropped(spark):
    rows = [
        (1, 0, "u", "Hello there\nSecond line"),
        (1, 1, "a", "> Hello there\n> Second line\nFine thanks"),
        (1, 2, "u", "third"),
        (1, 3, "a", "On Monday A wrote:\n> second LINE!\nbranch at zero"),
        (1, 4, "u", "after branch"),
        (1, 5, "u", "> > Hello there\n> > Second line\n> Fine thanks\nfive answers one"),
        (None, 1, "u", "q"),
        (2, None, "u", None),
        (2, 0, None, None),
        (2, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).orderBy("conv_id", "position").collect()
    first = [(r.turn, r.parent_turn, r.n_linked, r.text) for r in got if r.conv_id == 1]
    assert first == [
        (0, None, 0, "Hello there\nSecond line"), (1, 0, 3, "Fine thanks"), (2, 1, 0, "third"), (5, 1, 4, "five answers one"), (3, 0, 1, "branch at zero"), (4, 3, 0, "after branch"),
    ]
    assert len(got) == len(rows) and sorted(r.position for r in got if r.conv_id == 2 and r.turn is not None) == [0, 1]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_turns_beyond_a_block_and_nested_branches(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 3)
    rows = [(1, k, "u", f"message number {k}" + (f"\n> message number {q}" if (q := {5: 2, 8: 6, 9: 1}.get(k)) is not None else "")) for k in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).orderBy("position").collect()
    assert {r.turn: r.parent_turn for r in got if r.turn in (5, 8, 9)} == {5: 2, 8: 6, 9: 1}
    assert [r.turn for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert [r.position for r in got] == list(range(12))


def test_a_name_far_below_its_line_and_columns_of_the_caller(spark):
    text = "neither the name of\n" + "x y\n" * 300 + "nor the names of its contributors may be used to endorse or promote products derived from this software"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("_seq", "_FIRED", "_words", "_lines", "_windows", "_ranked", "_at")})
    row = licenses.scan(df).first()
    assert row.sentence_ids == ["bsd-endorse"] and row["_seq"] == row["_FIRED"] == 7
    judged = quality_rules.apply_rules(df)
    assert judged.columns[: len(df.columns)] == df.columns and all(judged.first()[c] == 7 for c in df.columns[2:])


def test_headers_tags_and_headings_name_one_licence_each(spark):
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    texts = {"// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", lgpl: "LGPL", "Licensed under the Eclipse Public License 2.0": "EPL-2.0", "EUPL": "EUPL", "Shared under\nlicensed under CC BY-ND 4.0": "CC-BY-ND", "License: MIT": "MIT", "MIT License\n\nCopyright notice.": "MIT"}
    got = {r.text: r.licenses for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {t: [n] for t, n in texts.items()}
