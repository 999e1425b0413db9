"""Token counts, piece coding, language ID, licences: against the libraries and plain definitions."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracelane.llm import language_id, license_scan, piece_coding, token_counts

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "\n\n a\tb\r\n", "<|endoftext|>x <|endoftext|>", "▁x ▁", "é中文🙂 ﬁ", "a" * 3000, ("word " * 30000), "</s><s>", "x\x00y"]


def frame(spark, texts=ODD):
    rows = [(i, t, "en", i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score int").repartition(3)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    out = token_counts.with_token_counts(frame(spark), JSON, batch_bytes=5000, keep_text=True).collect()
    assert len(out) == len(ODD)
    for r in out:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(lib.encode(t, add_special_tokens=False)))
        assert r.over_limit == (r.n_tokens > 512)
        assert r.n_tokens_in == r.doc_id


def test_texts_are_cut_at_safe_places_only():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", " ", "\n", "1", "<|endoftext|>", "'s", "é", "\t", ".", "  "]) for _ in range(rng.randrange(60)))
        assert "".join(token_counts.pieces(t, 5)) == t
        assert token_counts.count_texts([t], JSON, 5) == token_counts.count_texts([t], JSON, 10**9)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = piece_coding.with_pieces(frame(spark), MODEL, results=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), keep_text=True).collect()
    assert len(out) == len(ODD)
    for r in out:
        ids = lib.encode(r.text or "")
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert r.n_tokens_in == r.doc_id


def test_prefix_table_on_random_texts():
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_coding.coder(MODEL), random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("  abcdehlnorstuiéñ中🙂▁<>/.,0123\n\x7f") for _ in range(rng.randrange(30)))
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("run", ["0", "\t", "中", "あ", "🙂", "█", "0\t中", "\x00", "漢字仮名交", "0123456789", "xq☃", "สวัสดีชาวโลก", "ab中\n", "a", "▁"])
def test_long_runs_that_no_piece_joins(run):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_coding.PieceCoder(MODEL)
    for t in (run * 50_000, run * 5000, f"word{run * 5000} next", f"a\n{run * 5000}\nb", f"{run * 5000}word"):
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)


def test_piece_cache_of_two_generations(monkeypatch):
    own = piece_coding.PieceCoder(MODEL)
    monkeypatch.setattr(piece_coding, "CACHE", 2)
    first = own.encode("one two three four five")
    assert own.encode("one two three four five") == first and len(own.young) <= 2


def test_empty_tables(spark):
    none = frame(spark, []).select("doc_id", "text", "lang")
    assert token_counts.with_token_counts(none, JSON).count() == 0
    assert piece_coding.with_pieces(none, MODEL).count() == 0
    assert license_scan.with_licenses(none).count() == 0
    assert language_id.learn_profiles(none) == {}
    assert language_id.with_language(none, {}).count() == 0


def test_languages(spark):
    rows = [(1, "the cat and the dog and the house", "en"), (2, "le chat et le chien et la maison", "fr"), (3, None, "en"), (4, "x", None), (5, "123 $$", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(df)
    assert sorted(profiles) == ["en", "fr"]
    asked = spark.createDataFrame([(1, "the dog and the cat", 1), (2, "le chien et le chat", 2), (3, None, 3), (4, "", 4), (5, "12 !?", 5), (6, "ŁŽ" * 50000, 6)], "doc_id long, text string, score int")
    out = {r.doc_id: r for r in language_id.with_language(asked, profiles).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert all(0 <= r.score <= 1 and r.score_in == k for k, r in out.items())
    assert [k for k, r in out.items() if r.lang_pred == "und"] == [3, 4, 5]
    assert language_id.with_language(asked, profiles).where(language_id.rejected()).count() >= 3


def brute_profile(texts: list[str], size: int) -> list[str]:
    from collections import Counter

    count: Counter = Counter()
    for t in texts:
        words = "".join(c.lower() if c.isalpha() else " " for c in t).split()
        for w in words:
            count.update(w)
        padded = " " + " ".join(words) + " " if words else ""
        count.update(padded[i : i + 2] for i in range(len(padded) - 1))
        count.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return count


def test_languages_equal_a_plain_ranking(spark, data):
    """Every document against profiles and distances in plain Python, ties and odd texts included."""
    from binascii import crc32
    from collections import Counter

    size = language_id.PROFILE
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-k, t, "en" if k % 2 else None) for k, t in enumerate([*ODD, "ŁŽ" * 500, "abc cba bac", "q", "1 2"], 1)], docs.schema)
    docs = docs.unionByName(odd)
    rows = docs.collect()

    def first(gram: str) -> tuple:
        return ({3: 0, 1: 1, 2: 2}[len(gram)], [ord(c) * (-1 if len(gram) == 3 else 1) for c in gram.replace(" ", "\0")])

    def top(count) -> list[str]:
        return sorted(count, key=lambda g: (-count[g], first(g)))[:size]

    sums: dict = {}
    for r in rows:
        if r.lang is not None and r.text is not None and crc32(str(r.doc_id).encode()) % 3 != 1 and (count := brute_profile([r.text], size)):
            sums.setdefault(r.lang, Counter()).update(count)
    ranks = {of: {g: k for k, g in enumerate(top(count))} for of, count in sums.items()}
    want = {}
    for r in rows:
        own = top(brute_profile([r.text or ""], size))
        away = {of: sum(abs(rank[g] - k) if g in rank else size for k, g in enumerate(own)) for of, rank in ranks.items()}
        best = min(sorted(away), key=away.get)
        want[r.doc_id] = (best, pytest.approx(1 - away[best] / (size * len(own)))) if own else ("und", 0.0)
    got = language_id.with_language(docs, language_id.learn_profiles(docs.where(~language_id.held_out()))).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got} == want


def test_grams_equal_a_plain_count():
    import numpy as np

    from tracelane.llm.common import flat_text

    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice("abcÉñ 1.\n") for _ in range(rng.randrange(40)))
        import pyarrow as pa

        got = language_id.grams(*flat_text(pa.array([t, None, t])))
        want = brute_profile([t], 10)
        assert sorted(np.unique(got[0], return_counts=True)[1].tolist()) == sorted(want.values())
        assert len(got[1]) == 0 and (got[0] == got[2]).all()


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out()))
    out = language_id.with_language(docs.where(language_id.held_out()), profiles)
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(200).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


LICENSED = [
    ("Some prose here.\nReleased under the MIT License.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://x.org/L", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("The licence plate was blue. We license nothing.", []),
    ("no final mark\nMIT License\nmore words", ["MIT"]),
    ("x " * 100000 + "end.\nReleased under the MIT License.", ["MIT"]),
    (None, []), ("", []),
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string, licenses string")
    out = {r.doc_id: r for r in license_scan.with_licenses(df).collect()}
    for i, (_, want) in enumerate(LICENSED):
        assert out[i].licenses == want and out[i].licenses_in == "x"
    assert len(out[1].sentence_ids) == 3 and len(out[1].matches) == 1


GPL_HEADER = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{stop} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL_HEADER.format(what="program", mark=";", name="General Public License", stop=";", version="2")
GPL3 = GPL_HEADER.format(what="program", mark=":", name="General Public License", stop=",", version="3")
LGPL = GPL_HEADER.format(what="library", mark=";", name="Lesser General Public License", stop=";", version="2.1")
AGPL = GPL_HEADER.format(what="program", mark=":", name="Affero General Public License", stop=",", version="3")
MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
CC0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary.
"""
HEADERS = [
    (MIT, ["MIT"]), ("MIT License\n\n" + MIT, ["MIT"]), ("The MIT License (MIT)\n\n" + MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), ("Apache License\nVersion 2.0, January 2004", ["Apache-2.0"]),
    (GPL2, ["GPL-2.0-or-later"]), (GPL3, ["GPL-3.0-or-later"]), (LGPL, ["LGPL-2.1-or-later"]), (AGPL, ["AGPL-3.0-or-later"]),
    (GPL3.replace(", or\n(at your option) any later version", ""), ["GPL-3.0"]), (GPL3.replace(", either version 3 of the License, or\n(at your option) any later version", ""), ["GPL"]),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["GPL-3.0"]), ("GNU Lesser General Public License v2.1", ["LGPL-2.1"]), ("Licensed under the GPLv3 or later.", ["GPL-3.0-or-later"]), ("It is released under the GPL-2.0-only license.", ["GPL-2.0-only"]),
    ("Licensed under the GNU General Public License, version 3.\n\n" + GPL3, ["GPL-3.0", "GPL-3.0-or-later"]), ("Licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    (MPL, ["MPL-2.0"]), ("Mozilla Public License Version 2.0", ["MPL-2.0"]), (BSD2, ["BSD-2-Clause"]), (BSD2 + BSD_END, ["BSD-2-Clause"]), (BSD3, ["BSD-3-Clause"]), (BSD3 + BSD_END, ["BSD-3-Clause"]),
    ("Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + BSD3 + BSD_END, ["BSD-3-Clause"]), ("BSD 3-Clause License\n\n" + BSD3, ["BSD-3-Clause"]), (ISC, ["ISC"]), ("ISC License\n\n" + ISC, ["ISC"]),
    (ZLIB, ["Zlib"]), ("zlib License\n\n" + ZLIB, ["Zlib"]), (BOOST, ["BSL-1.0"]), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", ["BSL-1.0"]), (EPL, ["EPL-2.0"]), ("Eclipse Public License - v 2.0", ["EPL-2.0"]),
    (UNLICENSE, ["Unlicense"]), ("The Unlicense", ["Unlicense"]), (CC0, ["CC0-1.0"]), ("This work is licensed under CC0 1.0 Universal.", ["CC0-1.0"]),
    (CC.format(""), ["CC-BY-4.0"]), (CC.format("-ShareAlike"), ["CC-BY-SA-4.0"]), (CC.format("-NonCommercial"), ["CC-BY-NC-4.0"]), (CC.format("-NoDerivatives"), ["CC-BY-ND-4.0"]), (CC.format("-NonCommercial-ShareAlike"), ["CC-BY-NC-SA-4.0"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: (Apache-2.0 OR MIT)", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]), ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]), ("SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1-or-later"]),
    ("The tool is MIT licensed.", ["MIT"]), ("Copyright 2020 Some One. All rights reserved.", ["Proprietary"]), ("Dedicated to the public domain.", ["Public-Domain"]), ("This font software is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]),
    ("You need a license to fish in the lake.", []), ("He was licensed under the old law.", []), ("The report was released under pressure.", []), ("Permission is needed to park here.", []), ("The driving license", []),
]


@pytest.mark.parametrize("start", ["", "# ", " * "])
@pytest.mark.parametrize(("text", "licences"), HEADERS)
def test_standard_headers(text, licences, start):
    if start and "\n" in text:
        text = "".join(start + line if line.strip() else start.rstrip() + line for line in text.splitlines(keepends=True))
    matches = license_scan.standard(license_scan.GAP).scan(f"Some prose here.\n\n{text}\n\nMore prose.")[1]
    assert sorted({m[0] for m in matches}) == licences, matches


def test_every_known_sentence_is_found():
    from tracelane.llm import license_texts

    use = license_scan.standard(license_scan.GAP)
    for name, words in license_texts.known_sentences():
        said = words.replace("...", "some other words").capitalize()
        assert use.scan(f"Some prose. {said}. More.")[0] == [name] or name in {n for n, w in license_texts.known_sentences() if w.replace("...", "some other words") == said.lower()}, words
    for licence in ("MIT", "GPL-3.0-only", "CC-BY-NC-SA-4.0"):
        assert licence in license_texts.known_names().values()


OWN = [("a", "take it and run"), ("b", "run it ... twice"), ("b", "sing")]


def test_rules_need_their_order():
    use = license_scan.Recogniser(OWN, [("AB", ("a", "b"))], 0)
    assert [m[0] for m in use.scan("Take it and run. Sing.")[1]] == ["AB"]
    assert use.scan("Sing. Take it and run.")[1] == [] and use.scan("Take it and run. Unknown sentence. Sing.")[1] == []


@pytest.mark.parametrize("gap", [0, 1])
def test_gap_lets_unknown_sentences_through(gap):
    use = license_scan.Recogniser(OWN, [("AB", ("a", "b"))], gap)
    assert bool(use.scan("Take it and run. Something else. Sing.")[1]) == (gap == 1)


def test_own_sentences_need_no_cue_word():
    use = license_scan.Recogniser([("own", "take it and run")], [("Own", ("own",))], 0)
    assert use.scan("Hello there. Take it, and run!") == (["own"], [("Own", 13, 30)])


def test_licenses_of_the_documents(spark, data):
    """Against the five licence lines that the documents hold, found by plain patterns."""
    import re

    lines = {"GPL-3.0": r"licensed under the GNU General Public License, version 3", "MIT": r"Released under the MIT License", "CC-BY-NC-4.0": r"Licensed under CC BY-NC 4\.0", "Apache-2.0": r"Licensed under the Apache License, Version 2\.0", "Proprietary": r"All rights reserved"}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    some = 0
    for r in license_scan.with_licenses(docs).collect():
        want = {k for k, p in lines.items() if re.search(p, text[r.doc_id])}
        want = want - {"Proprietary"} or want
        some += bool(want)
        assert set(r.licenses) == want, text[r.doc_id]
    assert some


def test_a_worker_keeps_the_words_of_a_large_text(monkeypatch):
    import public_tokenizers

    from tracelane.llm import piece_coding

    use = piece_coding.PieceCoder(str(public_tokenizers.path("piece_bpe_32k.model")))
    text = " ".join(f"w{k}" for k in range(350_000))
    first = use.encode(text)
    monkeypatch.setattr(use, "word_ids", None)  # nothing is encoded anew
    assert use.encode(text) == first


def test_a_worker_lets_go_of_what_other_operators_keep():
    from tracelane.llm import common

    def work(batches):
        yield piece_coding.coder.cache_info().currsize

    piece_coding.coder(MODEL)
    work.__module__ = piece_coding.__name__
    assert list(common.tidy(work)(iter(()))) == [1]  # the operator's own task finds it
    work.__module__ = language_id.__name__
    assert list(common.tidy(work)(iter(()))) == [0]


def test_a_kept_word_is_little_more_than_itself_and_its_ids():
    import tracemalloc

    own = piece_coding.PieceCoder(MODEL)
    text = " ".join(f"word{k}" for k in range(50_000))
    own.encode(text[:1000])
    tracemalloc.start()
    own.encode(text)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(own.young) >= 50_000 and held < 250 * len(own.young)
