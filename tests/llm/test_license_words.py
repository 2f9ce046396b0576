import random

import pytest

from meterloom.llm import licenses


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.license_scan(df).collect()}


def brute(words, license, template, t=0.8):
    b = licenses.bigrams(licenses.words_of(template))
    every = ((i, j) for i in range(len(words)) for j in range(i + 2, min(len(words), i + 3 * sum(b.values())) + 1))
    own = licenses.Template(license, template, t, licenses.Counter())
    best = max((licenses.dice(licenses.bigrams(words[i:j]), b) for i, j in every if own.fits(words[i:j])), default=0)
    return best if best >= t else None


def test_licences_within_a_line(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    short = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts if len(t) < 120]
    texts = ["Licensed under CC BY-NC 4.0. See the LICENSE file for details.", f"{prose(40)} Licensed under the ISC License. {prose(40)} Licensed under CC BY 4.0. {prose(9)}"]
    texts += [f"{prose(30)} {t} {prose(30)}" for _, t in short] + [f"one\n{prose(30)} {licenses.TEMPLATES['MIT'][0]} {prose(9)}\n\ntwo"]
    got = found(spark, texts)
    assert got[0]["licenses"] == ["CC-BY-NC-4.0"]
    assert got[1]["licenses"] == ["CC-BY-4.0", "ISC"] and got[1]["lines"] == [[0, 0], [0, 0]]
    for i, (k, t) in enumerate(short):
        assert got[i + 2]["licenses"] == [k]
        assert got[i + 2]["dice"] == [pytest.approx(brute(licenses.words_of(texts[i + 2]), k, t))]
    assert got[len(texts) - 1]["licenses"] == ["MIT"] and got[len(texts) - 1]["lines"] == [[1, 1]]


def test_each_text_gets_its_own_name(spark):
    assert {"BSD-2-Clause", "GPL-2.0", "LGPL-3.0", "AGPL-3.0"} <= {k for k, ts in licenses.TEMPLATES.items() if len(ts) > 2}
    texts = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts]
    head = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
    for k, name, v in (("GPL-2.0", "General Public License", 2), ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3), ("GPL-3.0", "General Public License", 3)):
        texts.append((k, head.format(name, v, name)))
    # a whole BSD text as distributions have it
    with_names = next(t for t in licenses.TEMPLATES["BSD-3-Clause"] if t.endswith("SUCH DAMAGE.")).replace("the copyright holder nor", "the University nor")
    texts.append(("BSD-3-Clause", with_names))
    got = found(spark, [t for _, t in texts])
    assert [got[i]["licenses"] for i in range(len(texts))] == [[k] for k, _ in texts]


def test_versions_and_variants_are_told_apart(spark):
    texts = [
        ("Licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("This work is licensed under the GNU General Public License, version 1.", ["GPL-1.0"]),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]),
        ("Licensed under the GNU General Public License, version 4.", []),
        ("Licensed under the GNU General Public License.", []),
        ("Licensed under the Apache License, Version 3.0.", []),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.,\n51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n" + "and so on\n" * 300, ["GPL-2.0"]),
    ]
    got = found(spark, [t for t, _ in texts])
    assert [got[i]["licenses"] for i in range(len(texts))] == [w for _, w in texts]


def test_a_text_of_many_short_lines_takes_linear_time():
    import time

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    words = licenses.words_of(licenses.TEMPLATES["MIT"][0])

    def seconds(n):
        began = time.process_time()
        scanner.scan("\n".join(words[i * 7 % len(words)] for i in range(n)))
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000) + 1


def test_whole_texts_from_a_folder(tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Anyone may use the well known words of this own licence as they like, for ever and a day, version 1.0.")
    assert list(licenses.templates_from(str(tmp_path))) == ["Own-1.0"]
    own = licenses.Scanner(licenses.templates_from(str(tmp_path)), 0.8)
    assert [x[0] for x in own.scan("anyone may use the well known words\nof this own licence as they like, for ever and a day, version 1.0")] == ["Own-1.0"]


def test_abbreviations_and_words_beside_a_notice(spark):
    texts = [
        ("This file is licensed under the GPLv3.", ["GPL-3.0"]),
        ("Licensed under the GNU GPL version 3.", ["GPL-3.0"]),
        ("Licensed under the GNU GPL v2 or later", ["GPL-2.0"]),
        ("This file is licensed under the LGPLv2.1.", ["LGPL-2.1"]),
        ("This file is licensed under the AGPLv3.", ["AGPL-3.0"]),
        ("MIT licensed", ["MIT"]),
        ("The parser is small, fast, MIT licensed and has no dependencies.", ["MIT"]),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("Released under the New BSD license", ["BSD-3-Clause"]),
        ("Released under the Simplified BSD license", ["BSD-2-Clause"]),
        ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", ["GPL-2.0"]),
        ("// SPDX-License-Identifier: LGPL-3.0-only", ["LGPL-3.0"]),
        ("Licensed under CC BY 4.0, no warranty", ["CC-BY-4.0"]),
        ("Please share: licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under the MIT License, no warranty", ["MIT"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-No Derivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        # names that no template has
        ("This file is licensed under the EUPLv3.", []),
        ("This project is licensed under the terms of the Foo license.", []),
        ("SPDX-License-Identifier: Zlib", []),
        ("Licensed under the GNU GPL v4 or later", []),
        ("He is licensed under the law of the land, and shares no part of it.", []),
    ]
    got = found(spark, [t for t, _ in texts])
    assert [(t, got[i]["licenses"]) for i, (t, _) in enumerate(texts)] == texts
