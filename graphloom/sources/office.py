"""Texts of office files that are archives of XML, with the standard library, in Arrow-fed tasks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Which members hold the text of each kind, and the elements that end a line.
KINDS = {
    "docx": (r"word/document\.xml$", r"</w:p>"), "pptx": (r"ppt/slides/slide\d+\.xml$", r"</a:p>"), "xlsx": (r"xl/sharedStrings\.xml$", r"</si>"),
    "odt": (r"content\.xml$", r"</text:p>|</text:h>"), "odf": (r"content\.xml$", r"</text:p>|</text:h>"), "epub": (r"\.x?html$", r"</p>|</h\d>"),
}
PLACES = {"docx": "word/document.xml", "pptx": "ppt/slides/slide1.xml", "xlsx": "xl/sharedStrings.xml", "odt": "content.xml", "odf": "content.xml", "epub": "a.xhtml"}
TAGS = {"docx": "w:p", "pptx": "a:p", "xlsx": "si", "odt": "text:p", "odf": "text:p", "epub": "p"}


def _text(raw: bytes | None, kind: str) -> str | None:
    if raw is None or kind not in KINDS:
        return None
    members, ends = KINDS[kind]
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            xml = "\n".join(z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if re.search(members, n))
    except zipfile.BadZipFile:
        return None
    text = re.sub(r"<[^>]+>", "", re.sub(ends, "\n", xml))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = text.replace(a, b)
    return "\n".join(s for line in text.split("\n") if (s := line.strip()))


@F.pandas_udf(StringType())
def office_text(content: pd.Series, kind: pd.Series) -> pd.Series:
    """The lines of a docx, pptx, xlsx, odt, odf or epub file; null for what isn't one."""
    return pd.Series([_text(c, k) for c, k in zip(content, kind)], dtype="object")


@F.pandas_udf(BinaryType())
def office_file(text: pd.Series, kind: pd.Series) -> pd.Series:
    """A least file of a kind that holds a text, for tests and round trips."""

    def one(t, k):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(PLACES[k], f"<x><{TAGS[k]}>{escape(t)}</{TAGS[k]}></x>")
        return out.getvalue()

    return pd.Series([one(t, k) for t, k in zip(text, kind)], dtype="object")
