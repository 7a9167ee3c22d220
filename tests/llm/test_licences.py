"""The licence rule base: the untouched notice of every rule, grants by name and SPDX lines, and the SQL's rule."""

import duckdb
import pandas as pd
import pytest

from ledgerlens.llm import license_scan

GNU = ("This {3} is free software{0} you can redistribute it and/or\nmodify it under the terms of the GNU {1}\nLicense as published by the Free Software\n"
       "Foundation; either version {2} of the License, or (at your option)\nany later version.\n\nThis {3} is distributed in the hope that it will be useful.\n\n"
       "You should have received a copy of the GNU {1} License\nalong with this {3}.  If not, see <https://www.gnu.org/licenses/>.\n")
ONLY = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {0} License version {1} as\n"
        "published by the Free Software Foundation.\n")
MPL = ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
       "file, You can obtain one at https://mozilla.org/MPL/2.0/.\n")
EPL = ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\n"
       "https://www.eclipse.org/legal/epl-2.0/\n")
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\n"
         "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.\n")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
       "copyright notice and this permission notice appear in all copies.\n\n" + AS_IS)
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\n" + AS_IS
ZLIB = ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\n"
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\n"
        "including commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n")
CC0 = ("To the extent possible under law, the author(s) have dedicated all\ncopyright and related and neighboring rights to this software to the\n"
       "public domain worldwide. This software is distributed without any warranty.\n\nYou should have received a copy of the CC0 Public Domain Dedication along\n"
       "with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.\n")
LATER = [(name, family, v) for name, family, vs in (("General Public", "GPL", "2 3"), ("Lesser General Public", "LGPL", "2.1 3"),
         ("Library General Public", "LGPL", "2"), ("Affero General Public", "AGPL", "3")) for v in vs.split()]


def full(version):
    return version if "." in version else version + ".0"


CASES = [
    *[(GNU.format(cut, name, v, thing), f"{family}-{full(v)}-or-later") for name, family, v in LATER for cut, thing in ((":", "program"), (";", "library"), (",", "software"))],
    *[(ONLY.format(name, v), f"{family}-{full(v)}-only") for name, family, v in LATER],
    (MPL, "MPL-2.0"), (EPL, "EPL-2.0"), (ISC, "ISC"), (ZERO_BSD, "0BSD"), (ZLIB, "Zlib"), (CC0, "CC0-1.0"),
    ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD-style"),
    ("Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("Released under the Apache-2.0 license", "Apache-2.0"), ("This project is licensed under the terms of the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Available under the GNU GPL v2.", "GPL-2.0"), ("It is made available under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    *[(opening + "SPDX-License-Identifier: " + name + closing, name) for name, _, _ in license_scan.NAMES
      for opening, closing in (("// ", "\nint x;"), ("<!-- ", " -->\n<p>"))],
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0 OR ISC)\n", "Apache-2.0|MIT|ISC"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    # What names a licence without granting it, or none that is known.
    ("The Apache-2.0 license is long.", None), ("It was not released under the MIT license.", None), ("Released under the radar.", None),
    ("SPDX-License-Identifier: LicenseRef-Own", None), ("released\n\nunder the MIT license", None),
    ("released under the MIT license\nreleased under the ISC license", "MIT|ISC"), (None, None), ("", None), ("MIT " * 50_000, None),
]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan.scan(docs).collect()}


def test_every_notice_grant_and_identifier(scanned):
    wrong = {text[:80]: scanned.get(i) for i, (text, want) in enumerate(CASES) if text and (scanned.get(i, ("", None))[1] or None) != want}
    assert not wrong


def test_the_sql_states_the_same_rule(scanned):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, text) for i, (text, _) in enumerate(CASES)], columns=["doc_id", "text"]))
    assert {i: (ids, names) for i, ids, names in con.execute(license_scan.scan_oracle()).fetchall()} == scanned


def test_every_rule_can_be_met():
    ids = set(license_scan.SENTENCES.values()) | set(license_scan.named().values())
    assert all(i in ids or "%" in i for _, rule in license_scan.RULES for i in rule)
    assert all(any(a in s for a in license_scan.ANCHORS) for s in license_scan.SENTENCES)
    assert set(license_scan.VERBS) - {"licensed"} <= set(license_scan.ANCHORS)
