"""Who may see which row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.session import strip_blanks

ADMIN = "관리자"
WHOLE = "_전체"


@dataclass(frozen=True)
class Principal:
    """A caller: an organisation and a site in it. What is None doesn't restrict."""

    sosok: str | None = None
    site: str | None = None

    def stripped(self) -> Principal:
        return Principal(self.sosok and self.sosok.strip(), self.site and self.site.strip())

    @property
    def level(self) -> str:
        if self.sosok == ADMIN and self.site == ADMIN:
            return "admin"
        return "department" if (self.site or "").endswith(WHOLE) else "normal"


def can_see(who: Principal, sosok: Column | None = None, site: Column | None = None) -> Column:
    """One predicate of literals, which folds away for an admin and is pushed down otherwise."""
    sosok, site = F.col("sosok") if sosok is None else sosok, F.col("site") if site is None else site
    if who.level == "admin":
        return F.lit(True)
    out = F.lit(True)
    if who.sosok:
        out = out & sosok.contains(who.sosok) & (strip_blanks(sosok) == who.sosok)  # the first is cheap, and pushed down
    if who.site and not who.site.endswith(WHOLE):
        out = out & site.contains(who.site) & (strip_blanks(site) == who.site)
    return out
