"""Scalar functions as Column expressions: all run inside the JVM.

Text is trimmed as browsers trim it (any Unicode white space), integers are read
from the start of a text ("5日" is 5), and nothing raises on bad input: what can't
be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """The group, null without a match."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def is_blank(x: Column) -> Column:
    return x.isNull() | x.rlike(r"(?U)^\s*$")


def number_text(x: Column) -> Column:
    """A number as a browser prints it: whole numbers without decimals."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def lead_int(x: Column) -> Column:
    """The integer that a text starts with."""
    return extract(trim(x), r"^([+-]?\d+)").try_cast("int")


def pad2(x: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    return F.when(x.isNotNull(), F.format_string("%02d", x))


def roc_date(y: Column, m: Column, d: Column) -> Column:
    """Year, month and day of the Minguo calendar as YYYY-MM-DD, without a calendar check."""
    return F.concat((lead_int(y) + 1911).cast("string"), F.lit("-"), pad2(lead_int(m)), F.lit("-"), pad2(lead_int(d)))


def hour_minute(h: Column, m: Column) -> Column:
    return F.concat(pad2(lead_int(h)), F.lit(":"), pad2(lead_int(m)))


def to_number(x: Column) -> Column:
    """The number that a text holds, null if it holds none."""
    return F.when(trim(x).rlike(NUMBER), trim(x)).try_cast("double")


def round1(x: Column) -> Column:
    """To one decimal, halves towards plus infinity."""
    return F.floor(x * 10 + 0.5) / 10


def sci(x: Column) -> Column:
    """'6.0×104' is 60000: powers of ten whose superscript was lost."""
    p = r"^([\d.]+)\s*[×xX]\s*10(\d+)$"
    return extract(trim(x), p).try_cast("double") * F.pow(F.lit(10.0), extract(trim(x), p, 2).try_cast("double"))


def is_hm(x: Column) -> Column:
    return trim(x).rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")


def norm_hm(x: Column) -> Column:
    t = F.regexp_replace(trim(x), "^([^：]*)：", "$1:")
    return F.when(is_hm(t), F.concat(F.lpad(F.split(t, ":")[0], 2, "0"), F.lit(":"), F.split(t, ":")[1]))


def roc_dot(x: Column) -> Column:
    p = r"(\d{2,3})\s*[.]\s*(\d{1,2})\s*[.]\s*(\d{1,2})"
    return roc_date(extract(x, p, 1), extract(x, p, 2), extract(x, p, 3))


def niea(x: Column) -> Column:
    return extract(x, r"(NIEA\s+[A-Z]+\d+)")


def method_code(item: Column, method: Column, override: Column) -> Column:
    """The override of the item, else the method without its version, else the method."""
    return F.coalesce(override, extract(method, r"^(NIEA\s+[A-Z]+\d+)"), method)


def license_no(x: Column) -> Column:
    return extract(x, r"第0*(\d+)號").try_cast("int")


def zone(x: Column) -> Column:
    z = extract(x, "第([一二三四1234])類")
    return F.when(z.isNotNull(), F.concat(F.lit("第"), F.translate(z, "一二三四", "1234"), F.lit("類")))


def env_std(category: Column, note: Column) -> Column:
    road = F.when(note.contains("八公尺以上"), 2).when(note.contains("未滿八公尺"), 1).otherwise(0)
    return F.when(category == "道路交通噪音", road).otherwise(0)


def water_value(num: Column, txt: Column) -> Column:
    return F.coalesce(num, sci(txt), to_number(txt))


def censor_water(num: Column, txt: Column, t: Column | None = None, value: Column | None = None) -> dict[str, Column]:
    """``compare, value_num, value_txt`` of a measured value that is a number or a text. ``t`` and
    ``value``, the trimmed text and the number in it, can be columns that were worked out before."""
    t = trim(txt) if t is None else t
    value = water_value(num, txt) if value is None else value
    u = F.upper(t)
    below = t.startswith("<")
    rest = F.substring(t, 2, 1_000_000)
    isnum = value.isNotNull()
    return {
        "compare": F.when(isnum, None).when(u == "ND", "ND").when((u == "NA") | (t == "未檢測"), "未檢測").when(below, "<"),
        "value_num": F.when(isnum, value).when(below, to_number(rest)),
        "value_txt": F.when(isnum, None).when(u == "ND", "ND").when((u == "NA") | (t == "未檢測"), "未檢測").when(below, F.when(to_number(rest).isNull(), rest)).otherwise(txt),
    }


def censor_air(num: Column, txt: Column) -> dict[str, Column]:
    t = trim(txt)
    below, rest = t.startswith("<"), trim(F.substring(t, 2, 1_000_000))
    none = num.isNull() & (txt.isNull() | t.isin("", "--"))
    istxt = num.isNull() & ~none
    value = F.when(below, rest).otherwise(t)
    nd = istxt & (F.upper(t) == "ND")
    return {
        "compare": F.when(istxt & ~nd & below, "<"),
        "value_num": F.when(num.isNotNull(), num).when(istxt & ~nd, to_number(value)),
        "value_txt": F.when(nd, "ND").when(istxt & to_number(value).isNull(), value),
        "missing": none,
        "nd": nd,
    }


def mdl_text(txt: Column) -> Column:
    """A detection limit's text; dashes mean none."""
    return F.when(~trim(txt).isin("--", "─", "-"), txt)


def end_time(hour: Column) -> Column:
    return F.concat(pad2(F.when(hour == 0, 23).otherwise(hour - 1)), F.lit(":59"))


def date_serial(x: Column) -> Column:
    """Days since 1899-12-30 of a YYYY-MM-DD text."""
    return F.datediff(x.try_cast("date"), F.lit("1899-12-30").cast("date")).cast("long")


def time_serial(x: Column) -> Column:
    return (F.split(x, ":")[0].try_cast("int") * 60 + F.split(x, ":")[1].try_cast("int")) / 1440


def record_key(module: Column, site: Column, date: Column) -> Column:
    return F.when((site != "") & (date != ""), F.concat_ws("|", module, site, date))


def alias_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[，,]"), trim), lambda a: a != "")


def column_name(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_edit(kind: Column, raw: Column) -> dict[str, Column]:
    """``num, txt`` of an edited cell by the column's kind; blank is null."""
    t = trim(raw)
    date = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull(), t)
    number = to_number(t)
    return {
        "num": F.when(kind.isin("number", "coordsys", "text"), number),
        "txt": F.when(kind == "time", norm_hm(t)).when(kind == "date", date).when((kind == "text") & number.isNull(), F.nullif(t, F.lit(""))),
    }


def xml_escape(text: Column) -> Column:
    """A text as XML writes it, also within an attribute; line ends are kept by their number."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
