"""String cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, InPlace, chosen, non_empty
from quern.errors import InvalidInput
from quern.functions.exprs import q

_REF = re.compile(r"\$\$|\$\{(\w+)\}|\$(\w+)")
_EDGES = r"(?U)^\s+|\s+$"


def java_replacement(pattern: str, text: str) -> str:
    """``$1``, ``$name``, ``${name}`` and ``$$`` as the JVM's regex engine writes them; unknown references are refused."""
    groups = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern))

    def ref(m):
        if m.group() == "$$":
            return r"\$"
        name = m.group(1) or m.group(2)
        if name.isdigit():
            if int(name) > groups.groups:
                raise InvalidInput(f"replacement '{text}' refers to group {name}, which '{pattern}' does not have")
            return f"${int(name)}"
        if name not in groups.groupindex:
            raise InvalidInput(f"replacement '{text}' refers to group '{name}', which '{pattern}' does not have")
        return f"${{{name}}}"

    out, at = [], 0
    for m in _REF.finditer(text):
        out.append(text[at : m.start()].replace("\\", "\\\\").replace("$", r"\$"))
        out.append(ref(m))
        at = m.end()
    return "".join(out) + text[at:].replace("\\", "\\\\").replace("$", r"\$")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


class Clean(InPlace):
    kind = T.StringType

    def __init__(self, columns, trim, collapse, case, replacements):
        super().__init__(columns)
        self.trim, self.collapse, self.case, self.replacements = trim, collapse, case, replacements

    def expr(self, name):
        c = q(name)
        if self.trim:
            c = F.regexp_replace(c, _EDGES, "")
        if self.collapse:
            c = F.regexp_replace(c, r"(?U)\s+", " ")
        if self.case == "lower":
            c = F.lower(c)
        elif self.case == "upper":
            c = F.upper(c)
        elif self.case == "title":
            c = F.array_join(F.transform(words(c), capital), " ")
        elif self.case == "camel":
            c = F.array_join(F.transform(words(c), capital), "")
        for pattern, text in self.replacements:
            c = F.regexp_replace(c, pattern, text)
        return c


class StringCleaner(Estimator):
    """Trim, collapse white space, change case (``lower``, ``upper``, ``title``, ``camel``), then regex replacements in order."""

    def __init__(self, columns: list[str] | None = None, trim: bool = False, collapse_internal_ws: bool = False, case_style: str = "original", replacements: tuple = ()):
        if case_style not in ("original", "lower", "upper", "title", "camel"):
            raise InvalidInput(f"unknown case style '{case_style}'")
        self.columns, self.trim, self.collapse = columns, trim, collapse_internal_ws
        self.case_style, self.replacements = case_style, tuple(replacements)

    def _fit(self, df, target=None):
        cols = chosen(df, self.columns, T.StringType)
        non_empty(df)
        ready = []
        for pattern, text in self.replacements:
            try:
                ready.append(("(?U)" + pattern, java_replacement(pattern, text)))
            except re.error as e:
                raise InvalidInput(f"bad pattern '{pattern}': {e}") from e
        return Clean(cols, self.trim, self.collapse, self.case_style, ready)
