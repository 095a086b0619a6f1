"""Licence sentences and rules."""

from terrane.llm import licenses

from .rows import SCHEMA, awkward, row

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING MERCHANTABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
NAME = "3. Neither the name of X nor its contributors may be used to endorse or promote products.\n"
CASES = {
    "Some text. Released under the MIT License.": ["MIT"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
    "Licensed under CC BY-NC 4.0.\nMore.": ["CC-BY-NC-4.0"],
    "Licensed under the Apache License, Version 2.0 (the \"License\"). You may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at x. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.": ["Apache-2.0"],
    MIT: ["MIT"], BSD.format(NAME): ["BSD-3-Clause"], BSD.format(""): ["BSD-2-Clause"],
    "Copyright 2021 A. All rights reserved.": ["All-Rights-Reserved"],
    "SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0"],
    "Released under the MIT License. Also licensed under CC BY 4.0. Released under the MIT License.": ["MIT", "CC-BY-4.0", "MIT"],
    "// SPDX-License-Identifier: MIT\nint main(void) { return 0; }": ["MIT"],
    "# SPDX-License-Identifier: Apache-2.0 OR MIT\nimport os": ["Apache-2.0", "MIT"],
    "/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Linux-syscall-note) AND BSD-3-Clause */\nx": ["GPL-2.0", "BSD-3-Clause"],
    "SPDX-License-Identifier: MIT-0\nx": [],
    "Licensed under either of Apache License, Version 2.0 or MIT license": ["Apache-2.0", "MIT"],
    "This is licensed under the MIT license or the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
    "Available under MIT or Apache 2.0 or the Mozilla Public License 2.0, at your option.": ["MIT", "Apache-2.0", "MPL-2.0"],
    "MIT licensed": ["MIT"], "A book published by the MIT.": [],
    "The committee or the MIT license board met.": [],
    " * Copyright (c) 2019 Somebody Else\n * All rights reserved.\n * Some code": ["All-Rights-Reserved"],
    "// Copyright 2021 One\n// Copyright 2022 Two\n// Released under the\n// MIT License": ["MIT"],
    "A licence to kill, no permission at all.": [], "The cat sat.": [],
}


def test_cases(spark):
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(CASES)], SCHEMA)
    got = {r.doc_id: r._licences for r in licenses.scanned(docs).collect()}
    for k, want in enumerate(CASES.values()):
        listed = got[k].licences
        # rules are applied in their order, so the order of licences follows the text
        assert listed == want, (k, got[k])


def test_unmatched_sentences_are_told(spark):
    docs = spark.createDataFrame([row(1, "You may obtain a copy of the license at x.")], SCHEMA)
    assert licenses.scanned(docs).first()._licences.unmatched == ["apache_obtain"]


def test_awkward_and_empty(spark):
    docs = spark.createDataFrame([*awkward(), row(50, "x " * 200_000 + ". Released under the MIT License.")], SCHEMA)
    got = licenses.scanned(docs)
    assert got.columns == [*docs.columns, "_licences"]
    rows = got.collect()
    assert [r._licences.licences for r in rows if r.doc_id == 50] == [["MIT"]]
    assert all(r._licences.licences == [] for r in rows if r.doc_id != 50)
    assert licenses.scanned(docs.filter("false")).count() == 0


def test_query_text_is_the_same_in_sql(spark):
    import duckdb

    docs = spark.createDataFrame([row(k, t) for k, t in enumerate([*CASES, None, ""])], SCHEMA)
    got = {r.doc_id: (",".join(r._licences.sentences), ",".join(r._licences.licences), len(r._licences.unmatched)) for r in licenses.scanned(docs).collect()}
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    want = {k: (a, b, n) for k, a, b, n in duckdb.sql(licenses.oracle()).fetchall()}
    assert got == want
