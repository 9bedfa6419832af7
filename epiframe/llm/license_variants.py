"""Licence texts as LICENSE files hold them; ``license_digests.csv`` has the digest of each canonical form.

Short licences are written with each usual title and with numbered, lettered or bulleted
clauses; long ones are the files in ``licenses`` as their stewards publish them, with and
without what follows their terms.  ``python -m epiframe.llm.license_variants`` writes the
table again; a test holds it against the texts.
"""

from __future__ import annotations

import csv
from pathlib import Path

from epiframe.llm.license_digest import LICENSES, TABLE, canonical

_SHORT = dict(LICENSES)
_TITLES = {
    "MIT": ["MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "Licensed under the MIT License", "This software is released under the MIT license:"],
    "ISC": ["ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD License", "The BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD-2-Clause", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD License", "The BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause", "3-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["Unlicense", "The Unlicense", "Unlicense (Public Domain)"],
}
_TERMS_END = "END OF TERMS AND CONDITIONS"


def _clauses(text: str) -> list[str]:
    """A text with clauses numbered, lettered and bulleted."""
    if "1. " not in text:
        return [text]
    out = [text]
    for marks in ("abc", "   "):
        other = text
        for number, mark in enumerate(marks, 1):
            other = other.replace(f" {number}. ", f" {mark}. " if mark != " " else " * ")
        out.append(other)
    return out


def _holders(license_id: str, text: str) -> list[str]:
    """A text with the disclaimer's and the last clause's usual names of the holder."""
    out = [text]
    if license_id == "BSD-3-Clause":
        out += [t.replace("name of the copyright holder nor", "name of the University nor") for t in out]
        out += [t.replace(" nor the names of its contributors", " nor the names of contributors") for t in out]
    if license_id.startswith("BSD-"):
        out += [t.replace("COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE", f"{who} BE LIABLE") for t in out for who in ("COPYRIGHT HOLDERS OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")]
        out += [t.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS") for t in out if "REGENTS OR" in t]
    if license_id == "ISC":
        out += [t.replace("and/or distribute", "and distribute") for t in out]
    if license_id == "Unlicense":
        out += [t.replace("https://unlicense.org/", "http://unlicense.org") for t in out]
    return out


def _files() -> list[tuple[str, str]]:
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        terms, mark, _ = text.partition(_TERMS_END)
        if mark:
            out += [(path.stem, terms), (path.stem, terms + mark)]
    return out


def variants() -> list[tuple[str, str]]:
    """(license_id, text) of every known form, the built-in texts first."""
    out = list(LICENSES)
    for license_id, titles in _TITLES.items():
        if license_id in _SHORT:
            for text in _clauses(_SHORT[license_id]):
                for body in _holders(license_id, text):
                    out += [(license_id, body)] + [(license_id, f"{title}\n\n{body}") for title in titles]
    return out + _files()


def digests(spark) -> list[tuple[str, str]]:
    """The distinct (license_id, digest) of all forms; one digest has one licence."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(variants(), "license_id string, text string")
    found = {(r[0], r[1]) for r in rows.select("license_id", F.sha2(canonical(F.col("text")), 256)).collect()}
    assert len({d for _, d in found}) == len(found)
    return sorted(found)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    with TABLE.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("license_id", "license_digest"), *digests(SparkSession.builder.master("local[4]").getOrCreate())])
