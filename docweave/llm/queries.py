"""The queries on training data, and their SQL where there is any."""

from __future__ import annotations

from docweave.llm import form, knn, mix, neardup, oracles, pack, pii, split, templates


def queries() -> dict:
    return {"p1_found": templates.p1_found, "p1_clean": templates.p1_clean, "p2_found": neardup.p2_found, "p2_classes": neardup.p2_classes, "p4_found": knn.p4_found, "p5_found": form.p5_found, "p5_forms": form.p5_forms, "p5_classes": form.p5_classes, "p6_found": split.p6_found, "p6_pieces": split.p6_pieces, "p7_packed": pack.p7_packed, "p7_report": pack.p7_report, "p7_checked": pack.p7_checked, "p8_mixed": mix.p8_mixed, "p8_shares": mix.p8_shares, "p8_checked": mix.p8_checked, "p9_found": pii.p9_found, "p9_redacted": pii.p9_redacted}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
