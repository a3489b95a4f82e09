"""Small SQL fragments used to state comparisons."""

INTER = ("CASE WHEN least(a.x1,b.x1) > greatest(a.x0,b.x0) AND least(a.y1,b.y1) > greatest(a.y0,b.y0) "
         "THEN (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) ELSE 0.0 END")
OX = "(least(a.x1,b.x1)-greatest(a.x0,b.x0))"
OY = "(least(a.y1,b.y1)-greatest(a.y0,b.y0))"
PAGE = "a.artifact_id=b.artifact_id AND a.page=b.page"


def pr(expr: str, digits: int) -> str:
    """Round the exact binary value, half to even."""
    return f"(CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0)"


def digest(row_hash: str) -> str:
    limbs = ", ".join(
        f"CAST(sum(CAST(CAST(concat('0x', substr({row_hash}, {1 + 15 * i}, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
        for i in range(4))
    return f"sha256(concat_ws('|', CAST(count({row_hash}) AS VARCHAR), {limbs}))"
