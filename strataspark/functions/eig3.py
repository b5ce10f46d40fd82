"""Eigenvalues and the least eigenvector of symmetric 3x3 matrices in closed form.

The steps are columns of their own: each is computed once a row and used by name, which keeps the generated code
small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.vec import clip, vec


def with_eigen(df: DataFrame) -> DataFrame:
    """df (cxx, cxy, cxz, cyy, cyz, czz) with eigenvalues l1 <= l2 <= l3 and e1x, e1y, e1z: a unit eigenvector of l1,
    its component of greatest magnitude positive (null where none is singled out).

    Eigenvalues by the trigonometric solution of the characteristic equation; the eigenvector is the longest of the
    products of two rows of the matrix less l1, which vanish only for a multiple eigenvalue."""
    c = F.col
    df = df.withColumn("_q", (c("cxx") + c("cyy") + c("czz")) / 3)
    df = df.withColumn("_a", c("cxx") - c("_q")).withColumn("_b", c("cyy") - c("_q")).withColumn("_c", c("czz") - c("_q"))
    df = df.withColumn("_p", F.sqrt((c("_a") * c("_a") + c("_b") * c("_b") + c("_c") * c("_c") + 2 * (c("cxy") * c("cxy") + c("cxz") * c("cxz") + c("cyz") * c("cyz"))) / 6))
    det = c("_a") * (c("_b") * c("_c") - c("cyz") * c("cyz")) - c("cxy") * (c("cxy") * c("_c") - c("cyz") * c("cxz")) + c("cxz") * (c("cxy") * c("cyz") - c("_b") * c("cxz"))
    df = df.withColumn("_phi", F.when(c("_p") > 0, F.acos(clip(det / (c("_p") * c("_p") * c("_p")) / 2)) / 3).otherwise(0.0))
    df = df.withColumn("l1", F.greatest(c("_q") + 2 * c("_p") * F.cos(c("_phi") + 2 * math.pi / 3), F.lit(0.0))).withColumn("l3", c("_q") + 2 * c("_p") * F.cos("_phi"))
    df = df.withColumn("l2", 3 * c("_q") - c("l1") - c("l3"))
    df = df.withColumn("_xx", c("cxx") - c("l1")).withColumn("_yy", c("cyy") - c("l1")).withColumn("_zz", c("czz") - c("l1"))
    rows = vec("_xx", "cxy", "cxz"), vec("cxy", "_yy", "cyz"), vec("cxz", "cyz", "_zz")
    for name, product in (("_u", rows[0].cross(rows[1])), ("_v", rows[0].cross(rows[2])), ("_w", rows[1].cross(rows[2]))):
        df = df.withColumns({f"{name}{k}": part for k, part in zip("xyz", product.parts(), strict=True)})
    for name in ("_u", "_v", "_w"):
        v = vec(*[f"{name}{k}" for k in "xyz"])
        df = df.withColumn(f"{name}n", v.dot(v))
    first, second = (c("_un") >= c("_vn")) & (c("_un") >= c("_wn")), c("_vn") >= c("_wn")
    df = df.withColumn("_n", F.sqrt(F.greatest("_un", "_vn", "_wn")))
    df = df.withColumns({f"_e{k}": F.when(c("_n") > 0, F.when(first, c(f"_u{k}")).when(second, c(f"_v{k}")).otherwise(c(f"_w{k}")) / c("_n")) for k in "xyz"})
    x, y, z = (F.abs(f"_e{k}") for k in "xyz")
    df = df.withColumn("_s", F.when((x >= y) & (x >= z), F.signum("_ex")).when(y >= z, F.signum("_ey")).otherwise(F.signum("_ez")))
    df = df.withColumns({f"e1{k}": c(f"_e{k}") * c("_s") for k in "xyz"})
    return df.drop(*[n for n in df.columns if n.startswith("_")])
