"""Budgeted selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def pack_budget(items: DataFrame, budget: int) -> DataFrame:
    """``grp, id, cost, total`` of the items taken per group: best score first, ties by id; an item that does not fit is
    skipped and later ones may still fit, until the budget is used exactly. A group's candidates are one task's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        total, keep, sums = 0, [], []
        for cost in pdf["cost"]:
            fits = total + cost <= budget
            total += cost if fits else 0
            keep.append(fits)
            sums.append(total)
        return pdf.assign(total=sums)[keep][["grp", "id", "cost", "total"]]

    return items.groupBy("grp").applyInPandas(run, "grp string, id long, cost long, total long")
