"""Readers of messy cells as Column builders: no UDFs, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters with accents and what they become.
ACCENTS, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Month names.
MONTHS_FR = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
MONTHS_EN = "january february march april may june july august september october november december".split()
# Words of a status that says that someone left.
LEAVERS = "depart departed inactif inactive termine terminee terminated left former retired retraite resigned demission demissionnaire fired licencie quitte parti ancien".split()
# Words of a remark that speak well or badly of something, and those of its topics.
POSITIVE = "super excellent bien satisfait merci top rapide parfait".split()
NEGATIVE = "nul lent cher probleme problème decu déçu retard mauvais pire casse cassé incomplet".split()
TOPICS = {
    "price": "cher prix coût tarif facture".split(),
    "delivery": "livraison retard colis livreur arrivé attente".split(),
    "quality": "qualité cassé fragile solide beau moche".split(),
    "service": "service support réponse conseiller téléphone".split(),
}
# Labels of total rows. The sure ones need nothing else; the others need blank cells beside them.
SURE_TOTALS = ["total", "totaux", "totales", "totale", "sous-total", "sous total", "subtotal", "sub-total", "total general", "total global", "grand total", "recapitulatif"]
OTHER_TOTALS = ["somme", "sum", "moyenne", "average", "synthese"]
TOTAL_QUALIFIERS = "consolide consolidee general generale global globale annuel annuelle mensuel mensuelle entreprise groupe cumul cumule tous toutes all overall company grand final finale".split()
# What a yes-or-no column says.
YES, NO = "true oui 1 yes vrai y".split(), "false non 0 no faux n".split()
# Fragments of a status, in the order in which they decide.
STATUS_FRAGMENTS = [("cancelled", "annul|cancel|void"), ("draft", "brouillon|draft"), ("refunded", "rembours|refund|retour|return"), ("completed", "complet|paye|paid|livr|deliver|termine|done|closed"), ("pending", "attente|pending|open|partiel|unpaid")]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it: what only some branches of a `when` read is not shared otherwise."""
    return F.transform(F.array(x), f)[0]


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def strip_accents(x: Column) -> Column:
    return F.translate(x, ACCENTS, PLAIN)


def canonical_key(x: Column) -> Column:
    """Accents off, camelCase split, everything else than letters and digits one underscore."""
    x = F.regexp_replace(strip_accents(x), "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_number(x: Column) -> Column:
    """French, English and Swiss numbers; (500) is negative; k, M and Md multiply; signs of money and percent go.

    Of two kinds of separators the last is the decimal one. A lone separator before exactly three digits parts
    thousands, unless the whole part is 0 or longer than three digits. What has no digit is null.
    """
    return let(F.regexp_replace(F.trim(x), "[\\s\\u00a0\\u202f'’_]", ""), _signed)


def _signed(s: Column) -> Column:
    unit = F.lower(F.regexp_extract(s, r"(?i)\d(md|mrd|k|m|b)(?![a-z])", 1))
    times = let(unit, lambda u: F.when(u == "", 1.0).when(u == "k", 1e3).when(u == "m", 1e6).otherwise(1e9))
    value = let(F.regexp_replace(s, r"[^0-9.,]", ""), _plain) * times
    return let(value, lambda v: F.when(s.rlike(r"^\(.*\)$|^-|-$"), -v).otherwise(v))


def _plain(s: Column) -> Column:
    """A number of digits, commas and points alone."""
    comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    n_comma, n_dot = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    without = lambda ch, y: F.replace(y, F.lit(ch), F.lit(""))
    lone = lambda ch: F.when(s.rlike(rf"^[1-9]\d{{0,2}}[{ch}]\d{{3}}$"), without(ch, s)).otherwise(F.replace(s, F.lit(ch), F.lit(".")))
    plain = (
        F.when((n_comma > 0) & (n_dot > 0), F.when(comma < dot, F.replace(without(".", s), F.lit(","), F.lit("."))).otherwise(without(",", s)))
        .when(n_comma > 1, without(",", s))
        .when(n_dot > 1, without(".", s))
        .when(n_comma == 1, lone(","))
        .when(n_dot == 1, lone("."))
        .otherwise(s)
    )
    return F.when(s.rlike(r"\d"), plain.try_cast("double"))


def _month_names() -> dict[str, int]:
    """Beginnings of three letters or more of the French and English month names; the earlier month where two share one."""
    names: dict[str, int] = {}
    for i, both in enumerate(zip(MONTHS_FR, MONTHS_EN, strict=True), 1):
        for full in both:
            full = full.translate(str.maketrans(ACCENTS, PLAIN))
            for n in range(3, len(full) + 1):
                names.setdefault(full[:n], i)
    return names


def parse_date(x: Column, convention: str = "DMY") -> Column:
    """ISO, day or month first by the column's convention, spreadsheet serials 20000-60000, French and English month
    names, and YYYY-MM as its first day; a time is dropped; impossible dates are null."""
    return let(F.regexp_replace(F.trim(x), r"[T ]\d{1,2}:\d{2}.*$", ""), lambda s: _dated(s, convention))


def _whole(x: Column) -> Column:
    """Digits as a number; none is null, without a cast that fails, which costs more than all the rest."""
    return F.nullif(x, F.lit("")).cast("int")


def _dated(s: Column, convention: str) -> Column:
    serial = _whole(F.regexp_extract(s, r"^(\d{5})$", 1))
    first, second = ("dd", "MM") if convention == "DMY" else ("MM", "dd")
    slashed = F.regexp_replace(s, "[.-]", "/")
    return (
        F.when(s.rlike(r"^\d{5}$") & serial.between(20000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.coalesce(serial, F.lit(0))))
        .when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(s, F.lit("-01")), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}$"), F.try_to_date(slashed, f"{first[0]}/{second[0]}/yyyy"))
        .otherwise(let(strip_accents(F.lower(s)), _named))
    )


def _named(words: Column) -> Column:
    """A day, the name of a month and a year."""
    day, year = (_whole(F.regexp_extract(words, p, 1)) for p in (r"^(\d{1,2})(?:er|st|nd|rd|th)?\s", r"(\d{4})$"))
    number = F.create_map(*(F.lit(x) for kv in _month_names().items() for x in kv))[F.regexp_extract(words, r"([a-z]{3,9})\.?,?\s+\d{4}$", 1)]
    made = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(number.isNotNull() & day.isNotNull(), made)


def period_month(x: Column) -> Column:
    """A pay period as YYYY-MM: '03/2024', '2024.3', 'mars 2024'; YYYY-MM and YYYY-MM-DD stay; other dates as dates;
    what cannot be read is null."""
    s = strip_accents(F.lower(F.trim(x)))
    made = lambda y, m: F.when(m.between(1, 12), F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0")))
    front = _whole(F.regexp_extract(s, r"^(\d{1,2})[/.-]\d{4}$", 1)), F.regexp_extract(s, r"^\d{1,2}[/.-](\d{4})$", 1)
    back = _whole(F.regexp_extract(s, r"^\d{4}[/.-](\d{1,2})$", 1)), F.regexp_extract(s, r"^(\d{4})[/.-]\d{1,2}$", 1)
    name = F.create_map(*(F.lit(y) for kv in _month_names().items() for y in kv))[F.regexp_extract(s, r"^([a-z]{3,9})\.?\s+\d{4}$", 1)]
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), s), made(front[1], front[0]), made(back[1], back[0]), made(F.regexp_extract(s, r"(\d{4})$", 1), name), parse_date(x).cast("string"))


def date_convention(x: Column) -> Column:
    """N6, aggregate: DMY or MDY where a value over twelve proves it, null where none or both do."""
    # patterns, not casts: a cast that fails costs more than all the rest
    over, within = r"(1[3-9]|[2-9]\d)", r"(0?\d|1[0-2])"
    shows = lambda a, b: F.max(F.coalesce(x.rlike(rf"^{a}[/.-]{b}[/.-]\d{{4}}"), F.lit(False)))
    day_first, month_first = shows(over, within), shows(within, over)
    return F.when(day_first & ~month_first, "DMY").when(month_first & ~day_first, "MDY")


def number_convention(x: Column) -> Column:
    """N6, aggregate: 'point' or 'comma' where the column's values prove its decimal mark, null where none or both do.

    A mark before one, two, or four and more final digits is decimal, as is one after groups of thousands with the other.
    """
    s = F.regexp_replace(F.regexp_replace(F.trim(x), "[\\s\u00a0\u202f$€£%]", ""), r"^[-+(]+|\)$", "")
    proves = lambda d, t: F.max(F.coalesce(s.rlike(rf"^\d{{1,3}}(\{t}\d{{3}})+\{d}\d+$|^\d+\{d}(\d{{1,2}}|\d{{4,}})$"), F.lit(False)))
    point, comma = proves(".", ","), proves(",", ".")
    return F.when(point & ~comma, "point").when(comma & ~point, "comma")


def parse_number_by(x: Column, convention: Column) -> Column:
    """A number whose lone mark before three digits is read as the column's convention says; else parse_number."""

    def read(m: Column) -> Column:
        lone = m.rlike(r"^-?\d{1,3}[.,]\d{3}$")
        decimal = (convention == "point") & m.contains(".") | (convention == "comma") & m.contains(",")
        value = F.when(decimal, F.replace(m, F.lit(","), F.lit(".")).try_cast("double")).otherwise(F.regexp_replace(m, "[.,]", "").try_cast("double"))
        return F.when(lone & convention.isNotNull(), value).otherwise(parse_number(m))

    return let(F.trim(x), read)


def enum_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(x)), "[_-]", " "), "\\s+", " "))


def coerce_enum(x: Column, translations: dict[str, str], allowed: list[str], fallback: str | None = "autre", by_word: bool = False) -> Column:
    """An allowed value, its translation, what translates to it (accents, case and dashes off), with `by_word` the
    first word that says one, else the fallback; blank is null."""
    plain = lambda v: " ".join(v.lower().translate(str.maketrans(ACCENTS, PLAIN)).replace("_", " ").replace("-", " ").split())
    table = {plain(v): v for v in allowed}
    table |= {plain(k): v for k, v in translations.items() if v in allowed and plain(k) not in table}
    # the other way round: a schema in the translated language
    table |= {plain(v): k for k, v in translations.items() if k in allowed and plain(v) not in table}
    lookup = F.create_map(*(F.lit(y) for kv in table.items() for y in kv))
    key = enum_key(x)
    found = lookup[key]
    if by_word:
        found = F.coalesce(found, F.try_element_at(F.filter(F.transform(F.split(key, "[^a-z0-9]+"), lambda w: lookup[w]), lambda v: v.isNotNull()), F.lit(1)))
    return F.when(blank_to_null(x).isNotNull(), F.coalesce(found, F.lit(fallback)))


def parse_boolean(x: Column) -> Column:
    key = F.lower(F.trim(x))
    return F.when(key.isin(*YES), True).when(key.isin(*NO), False)


def coerce(x: Column, kind: str) -> Column:
    """A text as date, number, boolean or text; what cannot be read is null."""
    return {"date": parse_date, "number": parse_number, "boolean": parse_boolean, "string": blank_to_null}[kind](x)


def is_summary_row(first: Column, blanks: Column, n: Column) -> Column:
    """A total row by its first filled cell and how many of its n cells are blank.

    A sure label is enough; so is 'total' or 'grand' with qualifiers or years alone. Other words that can mean a total,
    alone or before or after a name, need a fifth of the cells blank, one at least.
    """
    words = "|".join([*SURE_TOTALS, *OTHER_TOTALS])

    def judged(key: Column) -> Column:
        qualified = key.rlike(rf"^[^a-z0-9]*(total|totaux|grand)([^a-z0-9]+(total|{'|'.join(TOTAL_QUALIFIERS)}|\d{{2,4}}))+[^a-z0-9]*$")
        may_be = key.rlike(rf"^({words})$|^({words}) | ({words})$")
        return F.coalesce(key.isin(*SURE_TOTALS) | qualified | may_be & (blanks >= F.greatest(F.lit(1), F.floor(n * 0.2))), F.lit(False))

    return let(strip_accents(F.lower(F.trim(first))), judged)


def sentiment(x: Column) -> Column:
    """+1 for every word of praise that a text contains, -1 for every one of blame."""
    low = F.lower(x)
    return sum((low.contains(w).cast("int") for w in POSITIVE), F.lit(0)) - sum((low.contains(w).cast("int") for w in NEGATIVE), F.lit(0))


def topics(x: Column) -> Column:
    """What a text is about."""
    low = F.lower(x)
    return F.array_compact(F.array(*(F.when(low.rlike("|".join(words)), name) for name, words in TOPICS.items())))


def issues(x: Column) -> Column:
    """Blame of prices or of deliveries."""
    bad, about = sentiment(x) < 0, topics(x)
    return F.array_compact(F.array(F.when(bad & F.array_contains(about, "price"), "price_sensitivity"), F.when(bad & F.array_contains(about, "delivery"), "delivery_delay")))


def is_summary_label(x: Column) -> Column:
    """A total, subtotal or mean line, by its first cell."""
    return F.coalesce(strip_accents(F.lower(F.trim(x))).rlike(r"^(grand[- ]?total|sous[- ]?total|sub[- ]?total|total( general| mensuel| annuel)?|moyenne|average|somme)\s*:?$"), F.lit(False))


def classify_status(x: Column) -> Column:
    """The first fragment found, in order; else unknown."""
    key, out = strip_accents(F.lower(x)), F.lit("unknown")
    for name, fragments in reversed(STATUS_FRAGMENTS):
        out = F.when(key.rlike(fragments), name).otherwise(out)
    return out


def classify_transaction(kind: Column, amount: Column, label: Column) -> Column:
    """income, expense or null: explicit type, else a negative sign, else keywords."""
    k, words = strip_accents(F.lower(kind)), strip_accents(F.lower(label))
    return (
        F.when(k.rlike("income|revenu|recette|credit|vente|sale"), "income")
        .when(k.rlike("expense|depense|debit|charge|cost"), "expense")
        .when(amount < 0, "expense")
        .when(words.rlike("vente|facture client|deposit|depot"), "income")
        .when(words.rlike("achat|loyer|salaire|fournisseur|rent|payroll"), "expense")
    )


def is_leaver(x: Column) -> Column:
    return F.arrays_overlap(F.split(strip_accents(F.lower(x)), "[^a-z]+"), F.array(*map(F.lit, LEAVERS)))


# Labels that mean all branches, or head office.
ALL_BRANCHES = "toutes succursales|toutes les succursales|tous|toutes|all branches|all locations|global|entreprise"
HEAD_OFFICE = "siege|siege social|bureau chef|head office|hq|quartier general"


def branch_key(x: Column) -> Column:
    """T10: 'City (Name)' is 'name'; case, accents and outer blanks do not count. All branches are '__all__', head
    office '__head_office__' and no label '__none__'."""
    key = F.trim(strip_accents(F.lower(x)))
    inner, outer = F.trim(F.regexp_extract(key, r"\(([^)]+)\)\s*$", 1)), F.trim(F.regexp_replace(key, r"\([^)]+\)\s*$", ""))
    office = lambda k: k.rlike(rf"^({HEAD_OFFICE})$")
    return F.when(F.coalesce(key, F.lit("")) == "", "__none__").when(key.rlike(rf"^({ALL_BRANCHES})$"), "__all__").when(office(key) | office(inner) | office(outer), "__head_office__").when(inner != "", inner).otherwise(key)


#: Bits of a value's key that one round of order_statistic looks at.
ROUND_BITS = 16


def order_statistic(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """One row: the element at floor(n * share) of the sorted values, without sorting them in one task.

    A quantile sketch brackets it, and what lies below the bracket is counted. Within the bracket it is found as a radix
    selection does: a value's place between the bracket's ends is a key of 32 bits; a histogram of the keys' high halves
    tells which of them holds the element, one of the low halves within that the key, and only values of that one key are
    ranked. No window sees more than 2^ROUND_BITS rows, or the distinct values of one part in 2^32 of the bracket.
    """
    v = F.col(value)
    bracket = df.agg(F.percentile_approx(value, F.array(F.lit(share - 0.0002), F.lit(share + 0.0002)), 100_000).alias("q"), F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    few = F.col("n") <= 10_000  # the sketch's bracket could miss a neighbour
    bracket = bracket.select(F.when(few, F.col("a")).otherwise(F.col("q")[0]).alias("lo"), F.when(few, F.col("b")).otherwise(F.col("q")[1]).alias("hi"), F.floor(F.col("n") * F.lit(share)).alias("rank"))
    span = (F.col("hi") - F.col("lo")).cast("double")
    place = F.when(span > 0, F.least(F.floor((v - F.col("lo")).cast("double") / span * 2.0 ** (2 * ROUND_BITS)), F.lit(2 ** (2 * ROUND_BITS) - 1))).otherwise(F.lit(0))
    marked = df.crossJoin(F.broadcast(bracket)).filter(v <= F.col("hi"))  # one row
    inside = v >= F.col("lo")
    counts = marked.groupBy(F.when(inside, v).alias("value"), F.when(inside, place).alias("key"), "rank").agg(F.count(F.lit(1)).alias("k"))
    counts = counts.withColumns({"high": F.shiftright("key", ROUND_BITS), "low": F.col("key").bitwiseAND(F.lit(2**ROUND_BITS - 1))})

    def holder(df: DataFrame, part: str, before: Column) -> DataFrame:
        """One row: which value of `part` holds the element, and how many rows come before it. What is below the bracket has none."""
        sums = df.groupBy(part, "rank", before.alias("__before")).agg(F.sum("k").alias("k"))
        upto = F.col("__before") + F.sum("k").over(Window.orderBy(F.col(part).asc_nulls_first()))
        sums = sums.select(part, "k", "rank", upto.alias("upto")).filter(F.col(part).isNotNull() & (F.col("upto") > F.col("rank")))
        return sums.agg(F.min(F.struct(F.col(part), (F.col("upto") - F.col("k")).alias("b"))).alias("x")).select(F.col(f"x.{part}").alias(part), F.col("x.b").alias("before"))

    near = counts.join(F.broadcast(holder(counts, "high", F.lit(0))), "high")
    near = near.join(F.broadcast(holder(near, "low", F.col("before")).withColumnRenamed("before", "at")), "low")
    upto = F.col("at") + F.sum("k").over(Window.orderBy("value"))
    ranked = near.groupBy("value", "rank", "at").agg(F.sum("k").alias("k")).select("value", "rank", upto.alias("upto"))
    return ranked.filter("upto > rank").agg(F.min("value").alias(name))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row, median: the element at floor(n / 2) of the sorted values."""
    return order_statistic(df, value, 0.5, "median")
