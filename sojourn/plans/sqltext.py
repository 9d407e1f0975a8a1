"""Small pieces of oracle SQL text that many queries share."""

MONEY = "cast(sum(total_price) as decimal(28,2))"
MAIN_IMAGE = "left join main_images mi on mi.tour_id=t.id"


def div(part: str, whole: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"(round(cast({part} as double)/nullif({whole},0)*{scale})/{scale})"


def pct(part: str, whole: str, digits: int = 4) -> str:
    scale = 10**digits
    return f"(round(cast({part} as double)*100/nullif({whole},0)*{scale})/{scale})"


def avg(column: str, digits: int = 2) -> str:
    return div(f"sum({column})", f"count({column})", digits)


def grow(current: str, previous: str) -> str:
    """Percent change with the rule for an empty previous window."""
    change = pct(f"({current})-({previous})", previous)
    return f"(case when {previous}>0 then {change} when {current}>0 then 100.0 else 0.0 end)"


def money_if(condition: str) -> str:
    return f"cast(coalesce(sum(case when {condition} then total_price end), 0) as decimal(28,2))"
