"""Licence scan by sentence rules.

Every sentence of a text is normalised and looked up among known licence
sentences, each with an identifier.  The identifiers of a text, in order, are
matched against ordered rules: a rule names a licence and the identifiers that
must follow one another (others may stand between).  DataFrame functions only;
the tables are small constants inside the plan.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The Free Software Foundation's licences: name in their notices, identifier, versions.
GNU = [("gnu general public license", "gpl", ("2", "3")), ("gnu lesser general public license", "lgpl", ("2.1", "3")),
       ("gnu library general public license", "library-gpl", ("2",)), ("gnu affero general public license", "agpl", ("3",))]
GNU_THINGS = ("program", "library", "software", "file")


def gnu_sentences() -> dict[str, str]:
    """The notices as their ':' and ';' cut them: what comes before a cut, after it, or whole."""
    known = {}
    for name, family, versions in GNU:
        for thing in GNU_THINGS:
            known[f"you should have received a copy of the {name} along with this {thing}"] = f"{family}-copy"
        for opening in ["", *(f"this {thing} is free software " for thing in GNU_THINGS)]:
            terms = f"{opening}you can redistribute it and or modify it under the terms of the {name}"
            published = "as published by the free software foundation"
            known[f"{terms} {published}"] = f"{family}-terms"
            for v in versions:
                later = f"either version {v} of the license or at your option any later version"
                known[later] = f"gnu-{v}-or-later"
                known[f"{terms} {published} {later}"] = f"{family}-terms-{v}-or-later"
                known[f"{terms} version {v} {published}"] = f"{family}-{v}-only"
    return known


# Licence sentences (lower case, words of letters, digits, dots and hyphens) and their identifiers.
SENTENCES = {
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-permission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-conditions",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "use of this source code is governed by a bsd-style license that can be found in the license file": "bsd-style-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-permission",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided as-is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-permission",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0": "epl2-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl-v10.html": "epl1-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-grant",
    "you should have received a copy of the cc0 public domain dedication along with this software": "cc0-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "all rights reserved": "all-rights",
    **gnu_sentences(),
}
# Licence, identifier of its grant, and the names a grant or an SPDX line may give it besides the
# first column in lower case, alone or before "license".
NAMES = [
    ("Apache-2.0", "apache2-grant", ["apache license version 2.0", "apache license version 2.0 the license", "apache license 2.0", "apache 2.0 license", "apache license v2.0"]),
    ("MIT", "mit-grant", ["expat license"]),
    ("GPL-3.0", "gpl3-grant", ["gnu general public license version 3", "gnu general public license v3.0", "gnu gpl v3", "gplv3"]),
    ("GPL-3.0-only", "gpl-3-only", []),
    ("GPL-3.0-or-later", "gpl-3-later-grant", ["gnu general public license version 3 or later", "gnu general public license v3.0 or later", "gplv3-or-later"]),
    ("GPL-2.0", "gpl2-grant", ["gnu general public license version 2", "gnu general public license v2.0", "gnu gpl v2", "gplv2"]),
    ("GPL-2.0-only", "gpl-2-only", []),
    ("GPL-2.0-or-later", "gpl-2-later-grant", ["gnu general public license version 2 or later", "gnu general public license v2.0 or later", "gplv2-or-later"]),
    ("LGPL-3.0", "lgpl3-grant", ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "gnu lgpl v3", "lgplv3"]),
    ("LGPL-3.0-only", "lgpl-3-only", []),
    ("LGPL-3.0-or-later", "lgpl-3-later-grant", ["gnu lesser general public license version 3 or later", "lgplv3-or-later"]),
    ("LGPL-2.1", "lgpl2.1-grant", ["gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "gnu lgpl v2.1", "lgplv2.1"]),
    ("LGPL-2.1-only", "lgpl-2.1-only", []),
    ("LGPL-2.1-or-later", "lgpl-2.1-later-grant", ["gnu lesser general public license version 2.1 or later", "lgplv2.1-or-later"]),
    ("LGPL-2.0-only", "library-gpl-2-only", ["gnu library general public license version 2"]),
    ("LGPL-2.0-or-later", "lgpl-2-later-grant", ["gnu library general public license version 2 or later"]),
    ("AGPL-3.0", "agpl3-grant", ["gnu affero general public license version 3", "gnu affero general public license v3.0", "gnu agpl v3", "agplv3"]),
    ("AGPL-3.0-only", "agpl-3-only", []),
    ("AGPL-3.0-or-later", "agpl-3-later-grant", ["gnu affero general public license version 3 or later", "agplv3-or-later"]),
    ("MPL-2.0", "mpl2-grant", ["mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v2.0"]),
    ("EPL-2.0", "epl2-grant", ["eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v2.0"]),
    ("EPL-1.0", "epl1-grant", ["eclipse public license version 1.0", "eclipse public license 1.0", "eclipse public license v1.0"]),
    ("BSD-3-Clause", "bsd3-grant", ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license"]),
    ("BSD-2-Clause", "bsd2-grant", ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "freebsd license"]),
    ("0BSD", "0bsd-grant", ["bsd zero clause license"]),
    ("ISC", "isc-grant", []),
    ("Zlib", "zlib-grant", []),
    ("BSL-1.0", "bsl1-grant", ["boost software license version 1.0", "boost software license 1.0"]),
    ("CC0-1.0", "cc0-grant", ["cc0 1.0", "cc0", "cc0 1.0 universal", "cc0 1.0 universal license", "creative commons zero v1.0 universal"]),
    ("CC-BY-NC-4.0", "cc-by-nc4-grant", ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"]),
    ("CC-BY-SA-4.0", "cc-by-sa4-grant", ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"]),
    ("CC-BY-4.0", "cc-by4-grant", ["cc by 4.0", "creative commons attribution 4.0 international license"]),
    ("Unlicense", "unlicense-grant", []),
]
# Licence rules, the most specific first; identifiers in the order in which they must appear
# ("%" spans one sentence or several: "gpl-terms-3-or-later", or "gpl-terms" and later "gnu-3-or-later").
RULES = [
    ("Apache-2.0 (notice)", ["apache2-grant", "apache2-compliance", "apache2-copy", "apache2-as-is", "apache2-see"]),
    ("MIT (text)", ["mit-permission", "mit-notice", "mit-as-is"]),
    *[(f"{family.upper().replace('LIBRARY-GPL', 'LGPL')}-{v if '.' in v else v + '.0'}-or-later", [f"{family}-terms%-{v}-or-later", f"{family}-copy"])
      for _, family, versions in GNU for v in versions],
    ("MPL-2.0", ["mpl-terms", "mpl2-copy"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-conditions", "bsd-source"]),
    ("BSD-style", ["bsd-style-grant"]),
    ("ISC", ["isc-permission", "isc-as-is"]),
    ("0BSD", ["0bsd-permission", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-permission"]),
    *[(licence, [grant]) for licence, grant, _ in NAMES],
    ("All rights reserved", ["all-rights"]),
]


def named() -> dict[str, str]:
    """Every name of a licence in a grant, and the identifier of that grant."""
    return {name: grant for licence, grant, names in NAMES
            for name in [licence.lower(), f"{licence.lower()} license", *names]}


#: Verbs of a grant; every known sentence holds one of these or of ``ANCHORS``, so a text without any has no known sentence.
VERBS = ("licensed", "released", "distributed", "available")
ANCHORS = ("licens", "software", "permission", "redistribut", "reserved", "released", "distributed", "available")
GRANT = (r"(?:this (?:project|software|work|program|library|package|file|code|source code) is |it is )?"
         rf"(?:made )?(?:{'|'.join(VERBS)}) under (?:the terms of )?(?:the |a |an )?")
SPDX = "spdx-license-identifier "


def sentence_pattern(space: str) -> str:
    """Known sentences, the longest first, then grants, then SPDX lines; ``space`` stands for a blank in them."""
    def any_of(of) -> str:
        return "|".join(re.escape(x).replace(r"\-", "-") for x in sorted(of, key=lambda x: (-len(x), x)))
    spdx = any_of(licence.lower() for licence, _, _ in NAMES)
    whole = rf"{any_of(SENTENCES)}|{GRANT}(?:{any_of(named())})|{SPDX}(?:{spdx})(?: (?:or|and) (?:{spdx}))*"
    return whole.replace(r"\ ", " ").replace(" ", space)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in order.  In it ``\\r`` ends a
    sentence for certain and ``\\n`` may end one or stand inside one: every known
    sentence that begins and ends at such places is found, the longest first."""
    known = F.create_map(*[F.lit(x) for pair in {**SENTENCES, **named()}.items() for x in pair])
    plain = F.regexp_replace(text, r"[^a-z0-9.\n\r-]+", " ")
    plain = F.regexp_replace(plain, r"(?<![ .\n-])[ .\n-]*+\r[ .\n\r-]*", "\r")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<![ .-])[ .-]*+\n[ .\n-]*", "\n"), r"^[ .\n\r-]+|(?<![ .\n\r-])[ .\n\r-]++$", "")
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![^\n\r])(?:{sentence_pattern('[ \\n]')})(?![^\n\r])"), F.lit(0))
    names = F.flatten(F.transform(F.transform(found, lambda s: F.translate(s, "\n", " ")), lambda s: F.when(
        s.startswith(SPDX), F.split(F.substring(s, len(SPDX) + 1, 1 << 30), " (?:or|and) ")).otherwise(
        F.array(F.regexp_replace(s, "^" + GRANT, "")))))
    return F.transform(names, lambda s: F.try_element_at(known, s))


def follows(ids: Column, rule: list[str]) -> Column:
    """Whether ``ids`` has the rule's identifiers in order: a gap pattern over the joined identifiers."""
    return F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).like("%|" + "|%|".join(rule) + "|%")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` for every row with a known sentence.

    Sentences end at ``. ! ? ; :`` before white space and at blank lines.  A
    line break may end one or, in wrapped text, stand inside one: both readings
    count at every place.  A grant (``licensed under the ...``) and an SPDX line
    (``or`` and ``and`` join identifiers) name their licence.  ``sentence_ids`` and ``licenses`` are joined by ``|``
    (``licenses`` in rule order, empty where no rule is complete).  Null or
    empty text has no sentence; repeated rows repeat."""
    lower = F.lower(F.regexp_replace(text_or_empty(), r"[\r\x0B\f]", " "))
    lower = F.regexp_replace(F.regexp_replace(lower, SPDX.strip() + r":[ \t]*", SPDX), r"([0-9])\+", "$1-or-later")
    stopped = F.regexp_replace(F.regexp_replace(lower, r"([.!?;:])[ \t\n]+", "$1\r"), r"\n{2,}", "\r")
    some = functools.reduce(Column.__or__, [F.contains(F.lower(text_or_empty()), F.lit(a)) for a in ANCHORS])
    rows = docs.where(some).select("doc_id", identifiers(stopped).alias("ids")).where(F.size("ids") > 0)
    licences = F.array(*[F.when(follows(F.col("ids"), rule), F.lit(name)) for name, rule in RULES])
    return rows.select("doc_id", F.array_join("ids", "|").alias("sentence_ids"),
                       F.array_join(F.array_distinct(F.filter(licences, lambda x: x.isNotNull())), "|").alias("licenses"))


def scan_oracle() -> str:
    """The scan in DuckDB SQL, by the same rule: both readings of line breaks count at
    every place.  Its patterns know no look-around, so every end is doubled first
    and each match takes one of the two."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**SENTENCES, **named()}.items()) + "}"
    rules = ", ".join(f"CASE WHEN joined LIKE '%|{'|%|'.join(rule)}|%' THEN '{name}' END" for name, rule in RULES)
    return f"""
WITH low AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[\\r\\v\\f]', ' ', 'g')),
  '{SPDX.strip()}:[ \\t]*', '{SPDX}', 'g'), '([0-9])\\+', '\\1-or-later', 'g') AS t FROM documents),
ends AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.!?;:])[ \\t\\n]+', '\\1' || chr(13), 'g'), '\\n\\n+', chr(13), 'g') AS t FROM low),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9.\\n\\r-]+', ' ', 'g'),
  '[ .\\n-]*\\r[ .\\n\\r-]*', chr(13), 'g'), '[ .-]*\\n[ .\\n-]*', chr(10), 'g'), '^[ .\\n\\r-]+|[ .\\n\\r-]+$', '', 'g') AS t FROM ends),
found AS (SELECT doc_id, regexp_extract_all(regexp_replace(t, '([\\n\\r])', '\\1\\1', 'g'),
  '(?:^|[\\n\\r])({sentence_pattern("(?: |" + chr(92) + "n" + chr(92) + "n)")})(?:$|[\\n\\r])', 1) AS s FROM plain),
i AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(list_transform(s, lambda x: replace(x, chr(10) || chr(10), ' ')),
  lambda x: CASE WHEN starts_with(x, '{SPDX}') THEN string_split_regex(substr(x, {len(SPDX) + 1}), ' (?:or|and) ')
  ELSE [regexp_replace(x, '^{GRANT}', '')] END)), lambda x: {known}[x]), lambda x: x IS NOT NULL) AS ids FROM found),
j AS (SELECT doc_id, ids, '|' || array_to_string(ids, '||') || '|' AS joined FROM i WHERE len(ids) > 0)
SELECT doc_id, array_to_string(ids, '|') AS sentence_ids,
  array_to_string(list_distinct_in_order, '|') AS licenses
FROM (SELECT doc_id, ids, list_filter([{rules}], lambda x: x IS NOT NULL) AS all_rules,
  list_filter(all_rules, lambda x, k: list_position(all_rules, x) = k) AS list_distinct_in_order FROM j)
"""
