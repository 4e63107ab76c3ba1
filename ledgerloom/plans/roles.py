"""The driver tables in the shapes the operators expect.

Every role is one ``select`` over whole driver tables. Its expressions are plain SQL that Spark and DuckDB read
alike, so both sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.session import once, spread

LETTERS = "กขคฆงจฉชซญฐณดตถทธนบปผฝพฟภมยรลวศษ"  # 32 plate letters

_K = "o_custkey"
_L1 = f"substr('{LETTERS}', cast(floor({_K} / 9999) % 32 as int) + 1, 1)"
_L2 = f"substr('{LETTERS}', cast(floor({_K} / 319968) % 32 as int) + 1, 1)"
_PLATE = f"concat(cast(cast(floor({_K} / 10238976) as bigint) % 9 + 1 as string), {_L2}, {_L1}, ' ', cast({_K} % 9999 + 1 as string))"
_TYPE = (
    "case o_orderpriority when '1-URGENT' then 'M' when '2-HIGH' then 'P' when '3-MEDIUM' then 'FIRE' "
    "when '4-NOT SPECIFIED' then 'PA' else 'MISC' end"
)
_FAMILY = (
    "case o_orderpriority when '1-URGENT' then '70' when '2-HIGH' then '72' when '3-MEDIUM' then '10' "
    "when '4-NOT SPECIFIED' then '11' else '20' end"
)
_WORD = (
    "case c_mktsegment when 'HOUSEHOLD' then 'สมบูรณ์' when 'MACHINERY' then 'รุ่งเรือง' when 'BUILDING' then 'มั่นคง' "
    "when 'AUTOMOBILE' then 'ยานยนต์' else 'ตกแต่ง' end"
)
_PLACE = (
    "case c_nationkey % 5 when 0 then 'ถนนสีลม' when 1 then 'ถนนพระราม' when 2 then 'หมู่บ้านสุขใจ' "
    "when 3 then 'ซอยอารีย์' else 'ถนนเพชรเกษม' end"
)
_HOUSE = "concat(cast(cast(floor(c_custkey / 50) as bigint) + 1 as string), '/', cast(c_custkey % 50 + 1 as string))"
_MAKE = "case c_nationkey % 4 when 0 then 'TOYOTA' when 1 then 'HONDA' when 2 then 'ISUZU' else 'MAZDA' end"
_YY = "lpad(cast((year({d}) + 543) % 100 as string), 2, '0')"
_START = "cast(o_orderdate as date)"
_END = "cast(o_orderdate + interval 365 day as date)"
_NUMBER = f"concat('D0-', {_FAMILY}, '-', {_YY.format(d='o_orderdate')}, '/', lpad(cast(o_orderkey as string), 10, '0'))"

POLICY_COLUMNS = {
    "id": "o_orderkey",
    "policy_number": _NUMBER,
    "company_code": "concat('N', cast(c_nationkey as string))",
    "policy_type": _TYPE,
    "insured_name": f"concat('นาย ', {_WORD}, ' ', substr(c_name, 10))",
    "insured_address": f"concat({_HOUSE}, ' ', {_PLACE}, ' เขต ', cast(c_nationkey + 1 as string))",
    "license_plate": _PLATE,
    "chassis_no": "concat('MRH', lpad(cast(o_custkey as string), 14, '0'))",
    "car_make": _MAKE,
    "coverage_start": _START,
    "coverage_end": _END,
    "total_premium": "cast(o_totalprice as decimal(18,2))",
    "manually_edited": "o_orderstatus = 'F'",
    "pdf_filename": (
        f"case when o_orderstatus = 'O' then concat(replace({_PLATE}, ' ', ''), ' กธ.', {_YY.format(d='o_orderdate')}, '.pdf') end"
    ),
    "pdf_url": (
        "case when o_orderstatus = 'O' then concat('https://pub.r2.dev/policies/', cast(o_orderkey as string), '.pdf') "
        "when o_orderstatus = 'F' then concat('https://old.example/storage/v1/object/public/docs/policies/', cast(o_orderkey as string), '.pdf?download=1') end"
    ),
    "pdf_size": "case when o_orderstatus = 'O' then cast(floor(o_totalprice) as bigint) end",
    "created_at": "o_orderdate",
    "customer_key": "o_custkey",
}

ATTACHMENT_COLUMNS = {
    "id": "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(floor(l_extendedprice * 100) as bigint) as string))",
    "policy_id": "l_orderkey",
    "doc_type": (
        "case l_linenumber when 1 then 'main' when 2 then 'prb' when 3 then 'endorsement' when 4 then 'receipt' "
        "when 5 then 'invoice' when 6 then 'other' else 'photo' end"
    ),
    "pdf_url": (
        "case when l_returnflag <> 'R' then concat('https://pub.r2.dev/attachments/', cast(l_orderkey as string), '%2D', "
        "cast(l_linenumber as string), '%2D', cast(l_partkey as string), '.pdf?v=1') end"
    ),
    "pdf_size": "cast(floor(l_extendedprice) as bigint)",
    "net_premium": "cast(l_extendedprice as decimal(18,2))",
    "quantity": "cast(l_quantity as decimal(18,2))",
    "discount": "cast(l_discount as decimal(9,4))",
    "tax": "cast(l_tax as decimal(9,4))",
    "coverage_start": "cast(l_shipdate as date)",
    "created_at": "l_shipdate",
}

_LABEL = (
    "case when l_linenumber = 5 then 'สลักหลัง' when l_linenumber = 6 then 'ใบแจ้งหนี้' when l_linenumber = 7 then 'ยกเลิก' "
    "when l_linestatus = 'F' then 'พรบ' else 'กธ' end"
)
_SHIP_YY = _YY.format(d="l_shipdate")
_STEM = (
    f"case l_returnflag when 'A' then replace({_PLATE}, ' ', '') "
    f"when 'N' then concat(replace({_HOUSE}, '/', '-'), {_PLACE}) else concat({_WORD}, substr(c_name, 10)) end"
)
FILE_COLUMNS = {
    "path": (
        f"concat('/scan/', cast(l_orderkey as string), '/', cast(l_partkey as string), '/', cast(l_suppkey as string), '/', "
        f"cast(l_linenumber as string), '/', cast(cast(floor(l_extendedprice * 100) as bigint) as string))"
    ),
    "name": f"concat({_STEM}, ' ', {_LABEL}, '.', {_SHIP_YY}, '.pdf')",
    "length": "cast(floor(l_extendedprice) as bigint)",
    "modified": "l_shipdate",
}

OBJECT_COLUMNS = {
    "object_key": (
        "concat('attachments/', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '.pdf')"
    ),
    "size": "cast(floor(l_extendedprice) as bigint)",
    "modified": "l_shipdate",
}

PAPER_COLUMNS = {
    "batch_id": "cast(user_id as string)",
    "file_id": "event_id",
    "pos": "event_id",
    "event_type": "event_type",
    "day": "cast(ts as date)",
    "marker": "props",
    "amount": "cast(value as decimal(18,2))",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


ROLE_SQL = {
    "policies": _select(POLICY_COLUMNS, "orders JOIN customer ON o_custkey = c_custkey"),
    "attachments": _select(ATTACHMENT_COLUMNS, "lineitem"),
    "files": _select(
        FILE_COLUMNS, "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    ),
    "objects": _select(OBJECT_COLUMNS, "lineitem"),
    "papers": _select(PAPER_COLUMNS, "events"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders join customer: one policy per order."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return _pick(orders.join(customer, orders.o_custkey == customer.c_custkey), POLICY_COLUMNS)


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: documents hung on policies."""
    return _pick(table(spark, sf_dir, "lineitem"), ATTACHMENT_COLUMNS)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem join orders join customer: one scanned file per line, named the way the archive names them.
    Orders meet their customers first: the lines, which are most, are shuffled once. A name is made once, however often it is read."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = line.join(orders.join(customer, orders.o_custkey == customer.c_custkey), line.l_orderkey == orders.o_orderkey)
    return _pick(once(joined, name=F.expr(FILE_COLUMNS["name"])), {**FILE_COLUMNS, "name": "name"})


#: What a file's path is made of: numbers, half the bytes of the text.
PATH_PARTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_cents"]
_CENTS = "cast(floor(l_extendedprice * 100) as bigint)"


def path_of_parts() -> Column:
    return F.expr(FILE_COLUMNS["path"].replace(_CENTS, "l_cents"))


def files_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with ``PATH_PARTS`` for the path, which ``path_of_parts`` makes of them. What a line's name and path need of its
    price and day is cut out before the line is shuffled."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    line = line.selectExpr("*", f"{_CENTS} AS l_cents", "year(l_shipdate) AS l_year")
    joined = line.join(orders.join(customer, orders.o_custkey == customer.c_custkey), line.l_orderkey == orders.o_orderkey)
    name = F.expr(FILE_COLUMNS["name"].replace("year(l_shipdate)", "l_year"))
    return once(joined, name=name).select(*PATH_PARTS, "name")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: an object listing."""
    return _pick(table(spark, sf_dir, "lineitem"), OBJECT_COLUMNS)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: documents arriving in batches."""
    return _pick(table(spark, sf_dir, "events"), PAPER_COLUMNS)


_SCHEDULE = (
    f"concat('THE MOTOR INSURANCE SCHEDULE', chr(10), 'Policy No: DO-', {_FAMILY}, '-', {_YY.format(d='o_orderdate')}, '/', "
    "substr(lpad(cast(o_orderkey as string), 10, '0'), 3), chr(10), 'The Insured', chr(10), "
    f"'นาย ', {_WORD}, ' ', substr(c_name, 10), chr(10), 'Address ', {_HOUSE}, ' ', {_PLACE}, chr(10), "
    "'MRH', substr(lpad(cast(o_custkey as string), 14, '0'), 1, 6), ' ', substr(lpad(cast(o_custkey as string), 14, '0'), 7), chr(10), "
    f"{_PLATE}, ' กรุงเทพมหานคร', chr(10), {_MAKE}, ' CITY ', cast(c_nationkey as string), chr(10), "
    "'From ', cast(day(o_orderdate) as string), '/', cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) + 543 as string), ' to ', "
    "cast(day(o_orderdate) as string), '/', cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) + 544 as string), chr(10), "
    "'Net Premium ', cast(cast(o_totalprice as decimal(18,2)) as string), chr(10), 'Stamp Duty ', cast(c_nationkey + 1 as string), '.00', chr(10), "
    "'VAT ', cast(c_custkey + 1 as string), '.50', chr(10), 'Total Premium ', "
    "cast(cast(o_totalprice as decimal(18,2)) + c_nationkey + c_custkey + 2 + cast(0.5 as decimal(18,2)) as string), chr(10), "
    "case o_orderstatus when 'O' then 'AXA' when 'F' then 'MSIG' else 'none' end, chr(10), 'Signed', chr(10), 'Checked', chr(10), 'Filed', chr(10), "
    "'Model YEAR ', cast(year(o_orderdate) as string))"
)
SCHEDULE_COLUMNS = {
    "doc_id": "o_orderkey",
    "text": _SCHEDULE,
    "truth_number": f"concat('D0-', {_FAMILY}, '-', {_YY.format(d='o_orderdate')}, '/', substr(lpad(cast(o_orderkey as string), 10, '0'), 3))",
    "truth_vin": "concat('MRH', lpad(cast(o_custkey as string), 14, '0'))",
    "truth_plate": f"replace({_PLATE}, ' ', '')",
    "truth_name": f"concat('นาย ', {_WORD}, ' ', substr(c_name, 10))",
    "truth_make": _MAKE,
    "truth_start": "cast(cast(o_orderdate as date) as string)",
    "truth_net": "cast(o_totalprice as double)",
    "truth_year": "cast(year(o_orderdate) as bigint)",
    "day_month": "concat(cast(day(o_orderdate) as string), '-', cast(month(o_orderdate) as string))",
}
ROLE_SQL["schedules"] = _select(SCHEDULE_COLUMNS, "orders JOIN customer ON o_custkey = c_custkey")


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders join customer: the text of one printed schedule per order, with the facts it was printed from. Orders are spread
    before the text is made: reading it is what costs."""
    orders, customer = spread(table(spark, sf_dir, "orders"), "o_orderkey"), table(spark, sf_dir, "customer")
    return _pick(orders.join(customer, orders.o_custkey == customer.c_custkey), SCHEDULE_COLUMNS)

_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as string)"
_DAY = "case when day(o_orderdate) > 28 then 28 else day(o_orderdate) end"
_THAI = "translate(cast(c_custkey as string), '0123456789', 'กขคงจฉชซดต')"
_LATIN = "translate(cast(c_custkey as string), '0123456789', 'abdefghijk')"
_TAIL = "lpad(cast(o_custkey as string), 8, '0')"
_SPAN = f"concat({_HOUSE}, ' ', {_PLACE}, ' กรุงเทพ 10', lpad(cast(c_nationkey as string), 3, '0'))"
_OLDER_NAME = f"concat(case when o_orderkey % 3 = 2 then 'คุณ ' else '' end, {_WORD}, ' ', {_THAI})"
_OLDER_PLATE = "concat(case when o_orderkey % 3 = 2 then '1' else '' end, 'กข ', cast(100 + o_custkey % 9000 as string), case when o_orderkey % 3 = 0 then ' กท' else '' end)"
_OLDER_MAKE = "case c_nationkey % 3 when 0 then 'TOYOTA' when 1 then 'KIA' else 'MAZDA' end"
_OLDER_MODEL = "case c_nationkey % 3 when 0 then 'YARIS' when 1 then 'SORENTO' else 'CX-30' end"
_OLDER_TEXT = (
    f"concat({_OLDER_PLATE}, case when o_orderkey % 4 = 1 then concat(' MRH', {_TAIL}, ' 2559 sedan') else '' end, chr(10), "
    "case o_orderkey % 4 when 0 then concat('Policy Numbcr : DO-70-41/', lpad(cast(o_orderkey as string), 8, '0')) "
    "when 1 then concat('ref Do-72-s9/', lpad(cast(o_orderkey as string), 8, '0')) "
    "when 2 then concat('A1-34-56r', lpad(cast(o_orderkey as string), 8, '0')) else 'number unknown' end, chr(10), "
    f"case o_orderkey % 3 when 0 then concat('ผู้เอาประกันภัย: ', {_OLDER_NAME}, chr(10)) when 1 then concat({_OLDER_NAME}, '  Insured Name', chr(10)) "
    f"else concat({_OLDER_NAME}, chr(10)) end, 'Use: own since 1999', chr(10), "
    f"case o_orderkey % 3 when 0 then concat('ที่อยู่ ', {_SPAN}) when 1 then concat('Address ', {_SPAN}, '  Driver any') else concat('at ', {_SPAN}, ' อาชีพ') end, chr(10), "
    f"case when o_orderkey % 4 = 0 then concat('Chassis No : MR$H', {_TAIL}, chr(10)) else '' end, {_OLDER_MAKE}, ' ', {_OLDER_MODEL}, chr(10), "
    "case when o_orderkey % 4 = 2 then concat('Model Yr: ', cast(year(o_orderdate) + 543 as string), chr(10)) else '' end, "
    f"'period ', cast({_DAY} as string), '/', cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) + 543 as string), "
    f"case when o_orderkey % 7 < 5 then concat(' until ', cast({_DAY} as string), '/', cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) + 544 as string)) else '' end, chr(10), "
    f"case o_orderkey % 3 when 0 then concat('Net Prem', case when o_orderkey % 2 = 0 then 'i' else '' end, 'ium (Baht) ', {_PRICE}) "
    f"when 1 then concat('Net Preniium ', chr(10), 'NETT AMOUNT 20.50 ', {_PRICE}, ' 333.00') "
    f"else concat('Net Premium : ', substr({_PRICE}, 1, length({_PRICE}) - 6), chr(39), substr({_PRICE}, length({_PRICE}) - 5)) end, chr(10), "
    "'Stamp Duty ', cast(c_nationkey + 1 as string), '.00', chr(10), 'VAT : ', cast(c_custkey as string), 'o5.50', chr(10), "
    f"case when o_orderkey % 5 = 1 then concat('TOTAL AMOUNT 150.00 ', {_PRICE}) else concat('Grand Total: ', {_PRICE}) end, chr(10), "
    f"'Agent : ', case when o_orderkey % 4 = 3 then 'Some Insurance' else concat('Somchai ', {_LATIN}) end, chr(10), 'License No: ', lpad(cast(c_custkey as string), 10, '0'), chr(10), "
    "case o_orderstatus when 'O' then 'company code: xyz' when 'F' then 'Falcon' else '' end)"
)
_IN_LINE = "o_totalprice > 100 and o_totalprice < 500000"
_PRICE_OUT = "cast(cast(o_totalprice as decimal(18,2)) as double)"
OLDER_COLUMNS = {
    "doc_id": "o_orderkey",
    "text": _OLDER_TEXT,
    "filename": "case when o_orderkey % 8 = 0 then 'CHADA KODWA 09.07.17.pdf' end",
    "truth_number": (
        "case o_orderkey % 4 when 0 then concat('D0-70-41/', lpad(cast(o_orderkey as string), 8, '0')) "
        "when 1 then concat('D0-72-S9/', lpad(cast(o_orderkey as string), 8, '0')) when 2 then concat('A1-34-56/', lpad(cast(o_orderkey as string), 8, '0')) end"
    ),
    "truth_company": "case o_orderstatus when 'O' then 'XYZ' when 'F' then 'FAL' end",
    "truth_name": f"case when o_orderkey % 8 = 0 then 'Chada Kodwa' else {_OLDER_NAME} end",
    "truth_address": f"case when o_orderkey % 3 <> 2 or c_nationkey % 5 <> 2 then {_SPAN} end",
    "truth_plate": _OLDER_PLATE,
    "truth_chassis": f"case o_orderkey % 4 when 0 then concat('MRH', {_TAIL}) when 1 then concat('MRH', {_TAIL}) end",
    "truth_make": _OLDER_MAKE,
    "truth_model": _OLDER_MODEL,
    "truth_year": "case o_orderkey % 4 when 1 then cast(2016 as bigint) when 2 then cast(year(o_orderdate) as bigint) else cast(1999 as bigint) end",
    "truth_start": f"concat(cast(year(o_orderdate) as string), '-', lpad(cast(month(o_orderdate) as string), 2, '0'), '-', lpad(cast({_DAY} as string), 2, '0'))",
    "truth_end": (
        f"case when o_orderkey % 7 < 5 then concat(cast(year(o_orderdate) + 1 as string), '-', lpad(cast(month(o_orderdate) as string), 2, '0'), '-', "
        f"lpad(cast({_DAY} as string), 2, '0')) when o_orderkey % 8 = 0 then '2017-07-09' end"
    ),
    "truth_net": (
        f"case when o_orderkey % 6 = 0 then {_PRICE_OUT} when o_orderkey % 6 = 3 then floor({_PRICE_OUT}) when {_IN_LINE} then {_PRICE_OUT} "
        "when o_orderkey % 3 = 1 then cast(333 as double) end"
    ),
    "truth_stamp": "cast(c_nationkey + 1 as double)",
    "truth_vat": "cast(c_custkey as double) * 100 + 5.5",
    "truth_total": f"case when o_orderkey % 5 <> 1 or {_IN_LINE} then {_PRICE_OUT} else cast(150 as double) end",
    "truth_broker": f"case when o_orderkey % 4 <> 3 then concat('Somchai ', {_LATIN}) end",
    "truth_license": "lpad(cast(c_custkey as string), 10, '0')",
}
ROLE_SQL["older_schedules"] = _select(OLDER_COLUMNS, "orders JOIN customer ON o_custkey = c_custkey")


def older_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders join customer: the text of an older schedule as a scan gives it, with the facts a reader should find."""
    orders, customer = spread(table(spark, sf_dir, "orders"), "o_orderkey"), table(spark, sf_dir, "customer")
    return _pick(orders.join(customer, orders.o_custkey == customer.c_custkey), OLDER_COLUMNS)



_NET, _STAMP, _VAT = (
    "cast(l_extendedprice as decimal(18,2))",
    "cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(9,4)) as decimal(18,2))",
    "cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(9,4)) as decimal(18,2))",
)
LEDGER_COLUMNS = {
    "id": ATTACHMENT_COLUMNS["id"],
    "policy_id": "l_orderkey",
    "doc_type": "case when l_linenumber > 5 then 'unknown' else 'motor_main' end",
    "policy_number": "case when l_linenumber < 7 then concat('D0-70-41/', cast(l_orderkey as string)) end",
    "license_plate": "case when l_linenumber < 6 then 'plate' end",
    "insured_name": "case when l_linenumber = 4 then concat('ตัวอย่าง อิเล็กทรอนิกส์ ', cast(l_suppkey as string)) else concat('ชื่อ ', cast(l_suppkey as string)) end",
    "chassis_no": "case when l_linenumber = 3 then concat('QRH', lpad(cast(l_partkey as string), 14, '0')) else concat('MRH', lpad(cast(l_partkey as string), 14, '0')) end",
    "net_premium": _NET,
    "stamp_duty": f"case when l_linenumber <> 2 then {_STAMP} end",
    "vat": _VAT,
    "total_premium": (
        f"cast({_NET} + {_STAMP} + {_VAT} + case when l_quantity > 45 then cast(cast(l_extendedprice as decimal(18,2)) * cast('0.05' as decimal(4,2)) as decimal(18,2)) "
        "when l_quantity > 40 then cast('0.02' as decimal(18,2)) when l_quantity > 38 then cast('0.01' as decimal(18,2)) "
        "else cast(0 as decimal(18,2)) end as decimal(18,2))"
    ),
    "coverage_start": "cast(l_shipdate as date)",
    "coverage_end": (
        "cast(case when l_quantity < 3 then l_shipdate - interval 1 day when l_quantity < 6 then l_shipdate + interval 800 day "
        "else l_shipdate + interval 365 day end as date)"
    ),
    "commission_pct": "cast(l_quantity as decimal(9,4))",
    "commission_baht": "case when l_linestatus = 'F' then cast(l_quantity as decimal(18,2)) end",
    "prepaid_tax_1pct": "cast(l_quantity as decimal(18,2))",
    "paired_prb_total": "case when l_returnflag = 'A' then cast(l_suppkey as decimal(18,2)) end",
}
ROLE_SQL["ledgers"] = _select(LEDGER_COLUMNS, "lineitem")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: one premium reading per line, some of them wrong on purpose."""
    return _pick(table(spark, sf_dir, "lineitem"), LEDGER_COLUMNS)
