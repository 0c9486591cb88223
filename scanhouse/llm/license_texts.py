"""License texts for the scan beside its short notices and headers, and the words that tell licenses apart."""

from __future__ import annotations

from pathlib import Path

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so"""
_KEEP = """, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
    copies or substantial portions of the Software. """
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ANY_PURPOSE = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
    ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
    THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
    conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_ADVERTISING = """All advertising materials mentioning features or use of this software must display the following
    acknowledgement: This product includes software developed by the organization. """
_ENDORSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission. """
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
    DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
    LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
    THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu_header(thing: str, name: str, version: str, end: str = ";") -> str:
    return f"""This {thing} is free software{":" if end == "," else ";"} you can redistribute it and/or modify it under the terms of
        the GNU {name} as published by the Free Software Foundation{end} either version {version} of the License, or (at your
        option) any later version."""


#: Other common licenses: notices, headers and the whole of short texts.
SHORT = {
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": _gnu_header("program", "General Public License", "2"),
    "LGPL-2.0 header": _gnu_header("library", "Library General Public License", "2"),
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 header": _gnu_header("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 header": _gnu_header("program", "Lesser General Public License", "3", ","),
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": _gnu_header("program", "Affero General Public License", "3", ","),
    "AGPL-3.0 opening": """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation,
        Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
        it is not allowed.""",
    "BSD notice": "Released under the BSD License.",
    "BSD-2-Clause notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "ISC notice": "Released under the ISC License.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0 notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
    "MIT text": _PERMISSION + _KEEP + _NO_WARRANTY,
    "MIT-0 text": _PERMISSION + ". " + _NO_WARRANTY,
    "JSON text": _PERMISSION + _KEEP + "The Software shall be used for Good, not Evil. " + _NO_WARRANTY,
    "ISC text": _ANY_PURPOSE + """, provided that the above copyright notice and this permission notice appear in all copies. """ + _ISC_WARRANTY,
    "0BSD text": _ANY_PURPOSE + ". " + _ISC_WARRANTY,
    "HPND notice": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without
        fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and
        this permission notice appear in supporting documentation.""",
    "BSD-2-Clause text": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause text": _BSD + _ENDORSE + _BSD_WARRANTY,
    "BSD-4-Clause text": _BSD + _ADVERTISING + _ENDORSE + _BSD_WARRANTY,
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0 text": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any
        person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
        "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of
        the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
        copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
        source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
        SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law.""",
}

#: Phrases that a found text must hold, each by one of its alternatives (``|``): all words in a row, none between them.
#: Of the words marked ``?``, one (in ten words two) may be unreadable: in its place stands a word without digits that no
#: template has. A GPL notice whose version is unreadable counts as version 3.
NAMES = {
    "Apache-2.0 notice": ["the apache license version 2 0"],
    "Apache-2.0 header": ["the apache license version 2 0|www apache org licenses license 2 0"],
    "MIT notice": ["the mit license"],
    "MIT": ["deal in the software|copies of the software|portions of the software"],
    "MIT text": ["deal in the software|copies of the software|portions of the software", "substantial portions|subject to the following conditions"],
    "JSON text": ["shall be used for good|good not evil"],
    "GPL-2.0 notice": ["the gnu general? public? license? version? 2"],
    "GPL-2.0 header": ["gnu? general? public? license?", "either version 2|version 2 of the license"],
    "GPL-3.0 notice": ["the gnu general? public? license? version? 3?"],
    "GPL-3.0 header": ["gnu? general? public? license?", "either version 3|version 3 of the license|either version? 3? of? the? license? or? at? your? option?"],
    "LGPL-2.0 header": ["gnu library general public license", "either version 2|version 2 of the license"],
    "LGPL-2.1 notice": ["the gnu lesser general? public? license? version? 2 1"],
    "LGPL-2.1 header": ["gnu? lesser general? public? license?", "either version 2 1|version 2 1 of the license"],
    "LGPL-3.0 notice": ["the gnu lesser general? public? license? version? 3"],
    "LGPL-3.0 header": ["gnu? lesser general? public? license?", "either version 3|version 3 of the license"],
    "AGPL-3.0 notice": ["the gnu affero general? public? license? version? 3"],
    "AGPL-3.0 header": ["gnu? affero general? public? license?", "either version 3|version 3 of the license"],
    "AGPL-3.0 opening": ["gnu affero general public license version 3 19 november 2007"],
    "CC-BY-NC-4.0 notice": ["under cc by nc 4 0"],
    "CC-BY-4.0 notice": ["under cc by 4 0"],
    "CC-BY-SA-4.0 notice": ["under cc by sa 4 0"],
    "CC-BY-ND-4.0 notice": ["under cc by nd 4 0"],
    "CC-BY-NC-SA-4.0 notice": ["under cc by nc sa 4 0"],
    "CC-BY-NC-ND-4.0 notice": ["under cc by nc nd 4 0"],
    "CC0-1.0 notice": ["under cc0 1 0"],
    "BSD notice": ["the bsd license"],
    "BSD-2-Clause notice": ["the bsd 2 clause license"],
    "BSD-3-Clause notice": ["the bsd 3 clause license"],
    "BSD-3-Clause text": ["neither the name|nor the names|may be used to endorse or promote products"],
    "BSD-4-Clause text": ["all advertising materials|features or use of this software must display"],
    "ISC notice": ["the isc license"],
    "ISC": ["any? purpose? with? or? without? fee?"],
    "ISC text": ["any? purpose? with? or? without? fee?", "provided that the above copyright notice|this permission notice appear in all copies"],
    "0BSD text": ["any? purpose? with? or? without? fee?"],
    "HPND notice": ["and its documentation", "for any purpose and without fee|supporting documentation"],
    "MPL-2.0 header": ["mozilla public license|mozilla org mpl 2 0", "license v 2 0|org mpl 2 0"],
    "MPL-2.0 notice": ["the mozilla public license version 2 0"],
    "EPL-2.0 notice": ["the eclipse public license version 2 0"],
    "BSL-1.0 notice": ["the boost software license version 1 0"],
    "Apache-2.0 whole": ["apache license version 2 0 january 2004"],
    "Artistic-1.0 whole": ["the artistic license"],
    "CC0-1.0 whole": ["cc0 1 0 universal"],
    "GFDL-1.2 whole": ["gnu free documentation license version 1 2 november 2002"],
    "GFDL-1.3 whole": ["gnu free documentation license version 1 3 3 november 2008"],
    "GPL-1.0 whole": ["gnu general public license version 1 february 1989"],
    "GPL-2.0 whole": ["gnu general public license version 2 june 1991"],
    "GPL-3.0 whole": ["gnu general public license version 3 29 june 2007"],
    "LGPL-2.0 whole": ["gnu library general public license version 2 june 1991"],
    "LGPL-2.1 whole": ["gnu lesser general public license version 2 1 february 1999"],
    "LGPL-3.0 whole": ["gnu lesser general public license version 3 29 june 2007"],
    "MPL-1.1 whole": ["mozilla public license version 1 1"],
    "MPL-2.0 whole": ["mozilla public license version 2 0"],
}


def whole_texts() -> dict[str, str]:
    """Long licenses in full, from the package's folder; read by the driver, templates travel with the tasks."""
    return {f"{p.stem} whole": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
