"""Complete licence texts, with and without title and appendix, and the usual headers of files.

Long texts are files beside this one, in the edition that Debian ships; short ones are built here.
"""

from __future__ import annotations

from importlib import resources

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, {}distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above
copyright notice and this permission notice appear in all copies"""
_ISC_REST = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
_BSD_TERMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.",
    "Neither the name of {} nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
)
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
_BSD_OWNERS = (
    ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"),
    ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
    ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"),
    ("REGENTS", "REGENTS"),
)
_BSD_NAMES = (
    "the copyright holder",
    "the copyright holders",
    "the copyright owner",
    "the University",
    "the organization",
    "the author",
)

_TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("", "ISC License", "The ISC License"),
    "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
}

_GPL_END, _APACHE_HEADER = "END OF TERMS AND CONDITIONS", "Licensed under the Apache License"


def _bsd(n_terms: int):
    for names in _BSD_NAMES if n_terms == 3 else ("",):
        for owners in _BSD_OWNERS:
            for mark in ("* ", "{}. "):  # bullets leave no trace in the canonical form, numbers do
                terms = [mark.format(i) + t.format(names) for i, t in enumerate(_BSD_TERMS[:n_terms], 1)]
                yield "\n\n".join([_BSD_GRANT, *terms, _BSD_REST.format(*owners)])


def _short():
    yield "MIT", _MIT
    for both in ("and/or ", "and "):
        yield "ISC", _ISC_GRANT.format(both) + _ISC_NOTICE + _ISC_REST
        yield "0BSD", _ISC_GRANT.format(both) + _ISC_REST
    for n in (2, 3):
        for text in _bsd(n):
            yield f"BSD-{n}-Clause", text


def _read(name: str) -> str:
    return resources.files(__name__).joinpath(f"{name}.txt").read_text("utf-8")


def _between(text: str, first: str, last: str) -> str:
    """From the last place of ``first`` to the end of the paragraph with ``last`` that follows."""
    begin = text.rindex(first)
    return text[begin:].partition(last)[0] + last


def _long():
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"):
        text = _read(name)
        yield name, text
        if _GPL_END in text:
            terms = text[: text.index(_GPL_END)]
            yield name, terms
            yield name, terms + _GPL_END
    yield "MPL-2.0", _read("MPL-2.0").partition("\nExhibit A")[0]


def _headers():
    apache = _between(_read("Apache-2.0"), _APACHE_HEADER, "limitations under the License.")
    gpl2 = _between(_read("GPL-2.0"), "This program is free software", "MA 02110-1301 USA.")
    gpl3 = _between(_read("GPL-3.0"), "This program is free software", "<https://www.gnu.org/licenses/>.")
    lgpl21 = _between(_read("LGPL-2.1"), "This library is free software", "02110-1301  USA")
    lgpl3 = gpl3.replace("GNU General Public License", "GNU Lesser General Public License")
    mpl = _between(_read("MPL-2.0"), "This Source Code Form is subject to", "http://mozilla.org/MPL/2.0/.")
    texts = {"Apache-2.0": apache, "GPL-2.0": gpl2, "GPL-3.0": gpl3, "LGPL-2.1": lgpl21, "LGPL-3.0": lgpl3, "MPL-2.0": mpl}
    for name, text in texts.items():
        yield name, text
        yield name, text.partition("\n\n")[0]  # the paragraph that names the licence


def complete_texts() -> list[tuple[str, str]]:
    """``(name, text)`` of whole licences and of headers; a text may stand more than once."""
    short = [(name, f"{title}\n\n{text}") for name, text in _short() for title in _TITLES[name]]
    return [*short, *_long(), *_headers()]
