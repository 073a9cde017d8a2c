"""Licence scans by canonical digest.

A text is brought to a canonical form (case, copyright lines, equivalent spellings,
punctuation, white space) and its SHA-256 is joined to the digests of known licences, as
a whole; each of its lines is looked up the same way among known notices, which stand
for a licence in one line.

Defined results: a null text has no digest and no licence; an empty one has the digest of
the empty form, which no licence has; repeated rows are scanned each; texts are whole
whatever their length, and however their lines are wrapped; columns other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, the second form being the canonical one; between words there is one blank and nothing else.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infring", "noninfring"),
    ("copyright holder", "copyright owner"),
    ("merchantib", "merchantab"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https ", "http "),
)
#: A line that only says whose the copyright is: the word with a sign or a year, or a sign with a year; or that all rights are reserved.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©)|copyright[ \t]+(19|20|\[?y|<y)|(\(c\)|©)[ \t]*(19|20)[0-9]|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"

# Texts of public licences, without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
# Titles that a licence's text may stand under; a text counts with and without them.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
    "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense",),
}
# Digests of the canonical forms of longer public licences, as published by their stewards.
DIGESTS = {
    "Apache-2.0": ("75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38",),
    "Artistic-1.0-Perl": ("bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "GFDL-1.2": ("b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd",),
    "GFDL-1.3": ("7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd",),
    "GPL-1.0": ("37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0",),
    "GPL-2.0": ("ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef",),
    "GPL-3.0": ("ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153",),
    "LGPL-2.0": ("bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c",),
    "LGPL-2.1": ("ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("c723f1c8033214c990abc66d271f80fce0ec8b02e61de8e6af2f8368a0e6727b",),
    "MPL-2.0": ("4e3ed3db421caff5beab12d8b5ed5c6f8edb888f5430801b1624448d4d7f04fe",),
    "BSD-3-Clause": ("21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",),
}
# One-line notices and what they stand for.
NOTICES = {
    "Released under the MIT License": "MIT",
    "Licensed under the MIT License": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "All rights reserved": "proprietary",
}


def _spelled(out: Column) -> Column:
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines; words parted by one blank each; canonical spellings, which therefore may stand across lines."""
    return _spelled(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), r"[^\p{L}\p{N}]+", " ")))


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, as an array; lines about copyright are lines like others."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(_spelled(kept), "\n", -1), lambda x: F.trim(x))


def canonical_text(text: str, lines: bool = False) -> str:
    """``canonical`` (or, of one line, ``canonical_lines``) for the known texts, which are few."""
    import regex

    out = text.lower() if lines else regex.sub(COPYRIGHT, " ", text.lower())
    out = regex.sub(r"[^\p{L}\p{N}]+", " ", out).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def _digest(text: str, lines: bool = False) -> str:
    return hashlib.sha256(canonical_text(text, lines).encode()).hexdigest()


def digests(texts: dict[str, str]) -> dict[str, str]:
    """Digest of each canonical form, with and without a title -> name."""
    found = {}
    for name, text in texts.items():
        titles = TITLES.get(name, ())
        bare = next((text[len(t) :] for t in titles if text.startswith(t)), text)
        found |= {_digest(form): name for form in (text, bare, *(f"{t}\n{bare}" for t in titles))}
    return found


def known_digests() -> dict[str, str]:
    return digests(TEXTS) | {d: name for name, own in DIGESTS.items() for d in own}


def _notices(notices: dict[str, str]) -> dict[str, str]:
    return {_digest(t, lines=True): name for t, name in notices.items()}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(id_col, digest, license, notices, n_lines) of each document; ``notices`` are the licences its lines name, in order of the lines."""
    known = known_digests() if texts is None else digests(texts)
    lines = _notices(NOTICES if notices is None else notices)
    table = docs.sparkSession.createDataFrame(sorted(known.items()), "__digest string, __license string")  # as many rows as licences are known
    names = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair]) if lines else F.create_map().cast("map<string,string>")
    text = F.col(text_col)
    named = F.filter(F.transform(canonical_lines(text), lambda x: F.try_element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    rows = docs.select(F.col(id_col), F.sha2(canonical(text), 256).alias("__digest"), F.coalesce(named, F.array().cast("array<string>")).alias("__notices"), F.coalesce(n, F.lit(0)).cast("long").alias("__n"))
    return rows.join(F.broadcast(table), "__digest", "left").select(F.col(id_col), F.col("__digest").alias("digest"), F.col("__license").alias("license"), F.col("__notices").alias("notices"), F.col("__n").alias("n_lines"))


def oracle_sql() -> str:
    """The same scan of ``documents`` in DuckDB; notices joined by commas."""

    def spelled(out: str) -> str:
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    whole = spelled(rf"trim(regexp_replace(regexp_replace(lower(text), '{COPYRIGHT}', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')")
    by_line = spelled(r"regexp_replace(lower(text), '[^\p{L}\p{N}\n]+', ' ', 'g')")
    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    lines = ", ".join(f"('{d}', '{n}')" for d, n in sorted(_notices(NOTICES).items()))
    return rf"""
WITH known(digest, license) AS (VALUES {known}), notice(digest, name) AS (VALUES {lines}),
d AS (SELECT doc_id, text, sha256({whole}) AS digest, string_split({by_line}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d),
m AS (SELECT l.doc_id, string_agg(n.name, ',' ORDER BY k) AS notices FROM l JOIN notice n ON n.digest = sha256(trim(line, ' ')) GROUP BY 1)
SELECT d.doc_id, d.digest, known.license, coalesce(m.notices, '') AS notices, coalesce(len(ls), 0)::BIGINT AS n_lines
FROM d LEFT JOIN known USING (digest) LEFT JOIN m ON m.doc_id = d.doc_id"""
