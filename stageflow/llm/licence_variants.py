"""Whole licence texts as files have them: with and without title, appendix and line breaks."""

from __future__ import annotations

import re
from importlib.resources import files

from stageflow.llm.licences import TEXTS

# Usual titles of the short licences, which stand above the copyright lines.
TITLES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "The BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Revised BSD License", "Modified BSD License", "The BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Leading lines of each packaged text that are its title.
TITLE_LINES = {
    "Apache-2.0": 3, "Artistic-1.0-Perl": 1, "BSD-3-Clause": 0, "CC0-1.0": 2, "GFDL-1.2": 2, "GFDL-1.3": 2, "GPL-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.0": 2, "LGPL-2.1": 2,
    "LGPL-3.0": 2, "MPL-1.1": 2, "MPL-2.0": 1, "Unlicense": 0,
}
_END = re.compile(r"(?m)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$")
_ADDRESS = re.compile(r"51\s+Franklin\s+St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def packaged(name: str) -> str:
    return (files("stageflow.llm") / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8")


def _unwrapped(text: str) -> str:
    """Each paragraph on one line; lines such as "(c) ..." count as copyright lines, so line breaks can matter."""
    return "\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))


def _long(text: str, titles: int) -> list[str]:
    """The text with and without its first 1 to ``titles`` lines, the appendix after its end, and the placeholder for the owner."""
    lines = [x for x in text.split("\n") if x.strip()]
    at = [text.index(x) for x in lines[: titles + 1]]
    out = [text[a:] for a in at]
    ended = [(t, m) for t in out if (m := _END.search(t))]
    out += [t[: m.end()] for t, m in ended] + [t[: m.start()] for t, m in ended]
    out += [re.sub(r"(?m)^[ \t]*Copyright \[yyyy\].*$", "", t) for t in out if "[yyyy]" in t]
    out += [_ADDRESS.sub(a, t) for t in out if _ADDRESS.search(t) for a in _ADDRESSES]
    return out + [_unwrapped(t) for t in out]


def _bodies() -> dict[str, list[str]]:
    """Bodies of the short licences, by name."""
    out = {name: [TEXTS[name][0]] for name in ("MIT", "ISC", "BSD-2-Clause", "Zlib")}
    out["MIT"].append(TEXTS["MIT"][0].replace("this permission notice shall", "this permission notice (including the next paragraph) shall"))
    out["ISC"].append(TEXTS["ISC"][0].replace("and/or", "and"))
    two = TEXTS["BSD-2-Clause"][0]
    three = two.replace("THIS SOFTWARE IS", _CLAUSE_3 + "THIS SOFTWARE IS", 1)
    out["BSD-3-Clause"] = [three, three.replace("the copyright holder nor", "the copyright holders nor"), packaged("BSD-3-Clause").split("reserved.", 1)[1]]
    out["Unlicense"] = [packaged("Unlicense")]
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        out[name] += [re.sub(r"(?m)^[1-3]\. ", "", t) for t in out[name]]  # items marked by signs only
    return out


def whole_texts() -> dict[str, list[str]]:
    """Known texts by SPDX identifier: those of ``TEXTS`` and the whole licences in their usual forms."""
    out = {name: list(texts) for name, texts in TEXTS.items()}
    for name, bodies in _bodies().items():
        out.setdefault(name, []).extend([*bodies, *(f"{title}\n{body}" for title in TITLES[name] for body in bodies)])
    for name, titles in TITLE_LINES.items():
        if name not in TITLES:
            out.setdefault(name, []).extend(_long(packaged(name), titles))
    return out
