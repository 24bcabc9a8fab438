"""Known licences: full texts, headers and one-line notices, by SPDX identifier (fixed values)."""

from __future__ import annotations

from pathlib import Path

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{condition}

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{condition}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

#: (identifier, full text)
TEXTS = [
    ("MIT", "MIT License\n\n" + _MIT_GRANT.format(condition=""", subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""")),
    ("MIT", _MIT_GRANT.format(condition=""", subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""")),
    ("MIT-0", "MIT No Attribution\n\n" + _MIT_GRANT.format(condition=".")),
    ("ISC", "ISC License\n\n" + _ISC_BODY.format(condition=""", provided that the above
copyright notice and this permission notice appear in all copies""")),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_BODY.format(condition="")),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>
"""),
]

#: (identifier, the licence as notices name it)
NAMES = [
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache 2.0"),
    ("MIT", "the MIT License"),
    ("MIT", "MIT"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("ISC", "the ISC License"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("GPL-2.0-only", "the GNU General Public License, version 2"),
    ("GPL-3.0-only", "the GNU General Public License, version 3"),
    ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "the GNU Affero General Public License, version 3"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]

#: sentences around a licence's name
NOTICES = ["Licensed under {}.", "This work is licensed under {}.", "This software is licensed under {}.",
           "This file is licensed under {}.", "This project is licensed under {}.", "Released under {}.",
           "Distributed under {}.", "License: {}", "SPDX-License-Identifier: {}"]

#: (identifier, file of the full text in license_data, the text before which a shorter copy ends or None)
LONG_TEXTS = [
    ("Apache-2.0", "Apache-2.0", "APPENDIX:"), ("CC0-1.0", "CC0-1.0", None), ("MPL-1.1", "MPL-1.1", None), ("MPL-2.0", "MPL-2.0", None),
    ("GPL-1.0-only", "GPL-1", "Appendix: How to Apply"), ("GPL-2.0-only", "GPL-2", "How to Apply These"), ("GPL-3.0-only", "GPL-3", "How to Apply These"),
    ("LGPL-2.0-only", "LGPL-2", "How to Apply These"), ("LGPL-2.1-only", "LGPL-2.1", "How to Apply These"), ("LGPL-3.0-only", "LGPL-3", None),
    ("GFDL-1.2-only", "GFDL-1.2", "ADDENDUM:"), ("GFDL-1.3-only", "GFDL-1.3", "ADDENDUM:"),
]


def long_texts() -> list[tuple[str, str]]:
    """(identifier, full text) of the licences kept as files, with and without their instructions for use."""
    rows = []
    for name, file, end in LONG_TEXTS:
        text = (Path(__file__).parent / "license_data" / f"{file}.txt").read_text(encoding="utf-8")
        rows += [(name, text)] + ([(name, text[:text.rindex(end)])] if end else [])
    return rows


def _free_software() -> list[tuple[str, str]]:
    head, by = "is free software you can redistribute it and or modify it under the terms of", "as published by the free software foundation"
    rows = []
    for short, kind, versions in (("GPL", "general", "1 2 3"), ("LGPL", "library general", "2"), ("LGPL", "lesser general", "2.1 3"), ("AGPL", "affero general", "3")):
        for version in versions.split():
            name, v = f"{short}-{version if '.' in version else version + '.0'}", version.replace(".", " ")
            later, gnu = "or at your option any later version", f"the gnu {kind} public license"
            rows += [(f"{name}-or-later", f"{head} {gnu} {by} either version {v} of the license {later}"),
                     (f"{name}-or-later", f"{head} {gnu} {by} either version {v} {later}"),
                     (f"{name}-only", f"{head} {gnu} {by} version {v} of the license"),
                     (f"{name}-only", f"{head} {gnu} version {v} {by}"),
                     (f"{name}-only", f"{head} version {v} of {gnu} {by}")]
    return rows


#: (identifier, words that tell the licence in a standard header of several lines), in canonical form
HEADERS = [
    ("Apache-2.0", "under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("CC0-1.0", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software "
                "to the public domain worldwide"),
    *_free_software(),
    *((f"CC-{short}-{version}.0", f"licensed under {article} creative commons attribution{kind} {version} 0 {place} license")
      for short, kind in (("BY", ""), ("BY-SA", " sharealike"), ("BY-NC", " noncommercial"), ("BY-ND", " noderivatives"),
                          ("BY-NC-SA", " noncommercial sharealike"), ("BY-NC-ND", " noncommercial noderivatives"))
      for version, place in ((4, "international"), (3, "unported")) for article in ("a", "the")),
]

#: spellings that count as equal: (as found, as compared); word by word after normalising
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"),
]
