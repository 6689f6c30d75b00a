"""A person table derived from orders by integer arithmetic, alike in Spark and DuckDB.

Record = order, true entity = customer.  The same template renders for both
engines; only list access, integer division and date arithmetic differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.sources.tables import read_table

FIRST = "ANNA BRUNO CARLA DAVID ELENA FELIX GRETA HUGO IRENE JONAS KLARA LUKAS MARTA NADIA OSCAR PAULA QUENTIN ROSA SIMON TESSA URSULA VICTOR WANDA YANNIS".split()
LAST = "ALDER BIRCH CEDAR DOUGLAS ELMSLEY FARROW GARCIA HAWTHORN IVERSEN JUNIPER KESTREL LINDEN MARLOWE NORWOOD OAKLEY PALMER QUINCE ROWAN SCHMIDT THOMPSON UNDERWOOD VALDEZ WILLOW XIMENES YARROW ZELKOVA BRACKEN CLOVER DENNING EVERSON FENWICK".split()
STREETS = ["OAK ST", "ELM AVE", "N PINE RD", "MAPLE DR", "W CEDAR LN", "BIRCH CT", "ASH BLVD"]


class Spark:
    div = staticmethod(lambda a, b: f"({a} div {b})")
    pick = staticmethod(lambda items, i: "element_at(array(" + ", ".join(f"'{x}'" for x in items) + f"), cast({i} as int) + 1)")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    day = staticmethod(lambda n: f"date_add(date'1940-01-01', cast({n} as int))")
    month_day = staticmethod(lambda d: f"make_date(year({d}), day({d}), month({d}))")
    text = "string"


class Duck:
    div = staticmethod(lambda a, b: f"({a} // {b})")
    pick = staticmethod(lambda items, i: "list_extract([" + ", ".join(f"'{x}'" for x in items) + f"], cast({i} as integer) + 1)")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    day = staticmethod(lambda n: f"(date '1940-01-01' + cast({n} as integer))")
    month_day = staticmethod(lambda d: f"make_date(year({d}), day({d}), month({d}))")
    text = "varchar"


def person_sql(d, orders: str = "orders") -> str:
    """The person table as a query over orders."""
    k, c = "o_orderkey", "o_custkey"
    text = lambda x: f"cast({x} as {d.text})"
    first, last = d.pick(FIRST, f"{c} % {len(FIRST)}"), d.pick(LAST, f"({c} * 11 + 3) % {len(LAST)}")
    pad = lambda x, n: f"lpad({text(x)}, {n}, '0')"
    home = f"'312' || {pad(f'2000000 + ({c} * 37) % 7000000', 7)}"
    shared = f"'773' || {pad(f'2000000 + ({d.div(c, 4)} * 91) % 7000000', 7)}"
    return f"""
select rec_id, entity, first, last, case when swapped and day(born) <= 12 then {d.month_day('born')} else born end as dob, gov_id, phones, email, postal, addr, sex, is_valid
from (
    select 'R' || {pad(k, 8)} as rec_id, {c} as entity,
        case when {k} % 13 = 0 then substring(f, 1, length(f) - 1) when {k} % 53 = 0 then null else f end as first,
        case when {k} % 17 = 0 then l || 'E' when {k} % 59 = 0 then 'OTHER' else l end as last,
        {d.day(f'({c} * 17) % 25000')} as born, {k} % 19 = 0 as swapped,
        case when {k} % 11 <> 0 then {pad(f'(({c} * 104729 + 123456789) % 900000000)', 9)} end as gov_id,
        case when {k} % 7 = 0 then {d.array(home, shared)} when {k} % 31 = 0 then {d.array(shared)} else {d.array(home)} end as phones,
        case when {k} % 5 <> 0 then lower(f) || '.' || lower(l) || {text(c)} || '@mail.invalid' end as email,
        {pad(f'60000 + {c} % 900', 5)} as postal,
        {text(f'case when {k} % 23 = 0 then {k} % 900 + 1 else {c} % 997 + 1 end')} || ' ' || {d.pick(STREETS, f'{c} % {len(STREETS)}')} as addr,
        case when {k} % 29 = 0 then null when {c} % 2 = 0 then 'FEMALE' else 'MALE' end as sex,
        {k} % 97 <> 0 as is_valid
    from (select {k}, {c}, {first} as f, {last} as l from {orders}) o
) p"""


def person(spark: SparkSession, folder: str) -> DataFrame:
    read_table(spark, folder, "orders").select("o_orderkey", "o_custkey").createOrReplaceTempView("kinweave_orders")
    return spark.sql(person_sql(Spark, "kinweave_orders"))


def with_person(sql: str, *, ctes: str = "") -> str:
    """A DuckDB query with ``person`` (all records) and ``valid`` in front."""
    return f"with recursive person as ({person_sql(Duck)}), valid as (select * from person where is_valid){', ' + ctes if ctes else ''} {sql}"


def codes_cte(name: str, coder: Callable[[str], str | None]) -> str:
    """A CTE (value, code) of the last names that occur in the fixture."""
    names = sorted({*LAST, *[x + "E" for x in LAST], "OTHER"})
    return f"{name}(value, code) as (values " + ", ".join(f"('{n}', '{coder(n)}')" for n in names) + ")"


def first_codes_cte(name: str, coder: Callable[[str], str | None]) -> str:
    names = sorted({*FIRST, *[x[:-1] for x in FIRST]})
    return f"{name}(value, code) as (values " + ", ".join(f"('{n}', '{coder(n)}')" for n in names) + ")"
