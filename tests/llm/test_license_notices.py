"""Headers and licence files as blocks: wrapped, on one line, inside other text, across segments; SPDX lines."""

import textwrap

from panelcast.llm import license_texts, licenses

PROSE = "some words of a program that says nothing about its terms and mit der Zeit "
MIT = "Copyright (c) 2020 A. Person\n" + license_texts.MIT_GRANT + license_texts.MIT_REST
BSD3 = license_texts.BSD_GRANT + license_texts.BSD_TWO + license_texts.BSD_THIRD + license_texts.BSD_REST
BSD2 = license_texts.BSD_GRANT + license_texts.BSD_TWO + license_texts.BSD_REST
GPL3 = license_texts.gnu_notice(license_texts.GPL, "3").replace("This program", "Foo")


def wrapped(text, width, mark=" * "):
    return "/*\n" + "\n".join(mark + line for line in textwrap.wrap(text, width)) + "\n */\nint main() {}\n" + PROSE


def test_notices_of_every_shape(spark):
    texts = {
        "mit-line": (license_texts.MIT_GRANT, "MIT"), "mit-wrapped": (wrapped(MIT, 78), "MIT"), "mit-embedded": (PROSE * 60 + MIT + PROSE * 60, "MIT"),
        "bsd3-wrapped": (wrapped(license_texts.BSD_GRANT, 72, "# "), "BSD-3-Clause"), "bsd3": (wrapped(BSD3, 72), "BSD-3-Clause"), "bsd2": (wrapped(BSD2, 72), "BSD-2-Clause"), "bsd2-line": (BSD2, "BSD-2-Clause"),
        "gpl3": (wrapped(GPL3, 70, "// "), "GPL-3.0"), "gpl2": (wrapped(license_texts.gnu_notice(license_texts.GPL, "2"), 60), "GPL-2.0"), "lgpl": (wrapped(license_texts.gnu_notice(license_texts.LGPL, "2.1"), 60), "LGPL-2.1"),
        "short": ("This file is licensed under the MIT license.", "MIT"), "after": ("ten words of other prose stand here before the sentence Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "apache": (wrapped(license_texts.APACHE_NOTICE, 50, "# "), "Apache-2.0"), "spdx": ("// SPDX-License-Identifier: GPL-3.0-or-later\n" + PROSE, "GPL-3.0"), "spdx-or": ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT OR Apache-2.0"),
        "cut": ("word " * 500 + license_texts.APACHE_NOTICE, "Apache-2.0"), "unknown": ("This file is licensed under the Foo License. " + PROSE, None), "prose": (PROSE * 100, None), "empty": ("", None), "null": (None, None),
    }
    rows = [(i, f"{name}/x.c", text) for i, (name, (text, _)) in enumerate(texts.items())]
    got = {r.path.split("/")[0]: (r.license if r.evidence in ("file", "header") else None) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {name: want for name, (_, want) in texts.items()}


def test_weights_come_from_all_files(spark):
    files = spark.createDataFrame([(i, "software and nothing else" if i % 2 else "and") for i in range(40)], "id long, text string")
    _, idf, other = licenses.block_weights(files)
    assert idf["and"] == 1.0 and 1.0 < idf["software"] < idf["warranty"] and 1.0 < other < idf["warranty"]


def test_each_known_text_is_its_own_licence(spark):
    rows = [(i, f"d{i}/x.c", PROSE * 3 + text.upper() + "\n" + PROSE * 3) for i, (_, _, text) in enumerate(license_texts.BLOCKS)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {i: name for i, (name, _, _) in enumerate(license_texts.BLOCKS)}
