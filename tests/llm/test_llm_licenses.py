"""Licence scans on whole licence texts, odd lines, and the given tables."""

import pytest

from slowtide.llm.licenses import RULES, SENTENCES, TRIGGERS, scan_licences

from tests.llm.conftest import make_docs

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation."""
NAME = """
# 3. Neither the name of the owner nor the names of its contributors may be used to endorse or
#    promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""

MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES."""

CASES = [
    (MPL, ["MPL-2.0"]),
    (UNLICENSE, ["Unlicense"]),
    (LGPL, ["LGPL-2.1-or-later"]),
    (APACHE, ["Apache-2.0"]),
    (ISC, ["ISC"]),
    ("// SPDX-License-Identifier: MIT-0", []),
    ("// SPDX-License-Identifier: MIT", ["MIT"]),
    ("# SPDX-License-Identifier: (GPL-2.0-or-later)\nimport os", ["GPL-2.0-or-later"]),
    ("-- SPDX-License-Identifier: BSD-3-Clause-Clear\n", []),
    ("SPDX-License-Identifier: Unlicense.", ["Unlicense"]),
    ("Some v. 2.0. Released under the MIT License.", ["MIT"]),
    (MIT, ["MIT"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD + NAME, ["BSD-3-Clause"]),
    (GPL, ["GPL-3.0-or-later"]),
    ("Some words.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["Apache-2.0", "MIT"]),
    ("/* Released under\n * the MIT license. */ Released under the MIT License.", ["MIT"]),
    ("The software is provided as is, without warranty of any kind.", ["unknown warranty"]),
    ("No licence is given: released under the mitt license", []),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("", []),
    (None, []),
    ("x " * 100_000 + "\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    (MIT[:200] + "\n\n" + BSD + "\n\n" + MIT[-400:], ["BSD-2-Clause", "unknown warranty"]),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = scan_licences(make_docs(spark, [(i, t) for i, (t, _) in enumerate(CASES)])).collect()
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_case(scanned, number):
    assert scanned[number].licences == CASES[number][1], scanned[number].sentence_ids


def test_edges(edge_docs, no_docs):
    rows = scan_licences(edge_docs)
    assert set(edge_docs.columns) < set(rows.columns)
    assert all(r.licences == [] for r in rows.collect()) and scan_licences(no_docs).count() == 0


def test_tables_fit_together():
    assert all(any(t in words for t in TRIGGERS) for words in SENTENCES.values())
    assert {i for _, rule in RULES for i in rule} <= set(SENTENCES)


def test_no_python_in_the_plan(edge_docs):
    plan = scan_licences(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
