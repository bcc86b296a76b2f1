"""Event names, years, categories and team names from file names and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkframe.session import table


def event_name(file):
    """The part before the first underscore in upper case, and Women or Men if the file name has that in it."""
    low = F.lower(file)
    return F.concat(F.upper(F.split_part(file, F.lit("_"), F.lit(1))), F.when(low.contains("women"), "Women").when(low.contains("men"), "Men").otherwise(""))


def year(name):
    return F.nullif(F.regexp_extract(name, "[0-9]{4}", 0), F.lit("")).cast("int")


def category(name, is_mixed):
    """Case counts; junior events without a word for either are null."""
    return (
        F.when(is_mixed, "MD")
        .when(name.contains("WJCC"), F.when(name.contains("Women"), "Junior Women").when(name.contains("Men"), "Junior Men"))
        .when(name.contains("Women"), "Women")
        .when(name.contains("Men"), "Men")
        .when(name.contains("WMCC"), "Men")
        .when(name.contains("WWCC"), "Women")
    )


#: A country code and a name up to the next space. (?U) lets words end after accented letters on any Java.
TEAM = r"(?U)\b[A-Z]{3} - [^\s\n]+\b"
#: An end that is named as a power play.
POWER_PLAY = r"(?i)power play:\s*end\s+([0-9]+)"


def first_teams(text):
    """The first two teams that a text names; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(TEAM), F.lit(0))
    return F.get(found, 0), F.get(found, 1)


def stem(path):
    """the file's name without folders and without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def with_suffix(path, suffix: str):
    """the path with another last suffix, or with one if it has none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def q_event_category(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "wmcc").when(k % 4 == 1, "wwcc").when(k % 4 == 2, "wjcc").otherwise("owg")
    file = F.concat(kind, (F.lit(1990) + k % 35).cast("string"), F.lit("_Results"), F.when(k % 3 == 0, "_men").when(k % 3 == 1, "_Women").otherwise(""), F.lit(".pdf"))
    name = event_name(file)
    return table(spark, d, "part").select("p_partkey", name.alias("event_name"), year(name).alias("year"), category(name, k % 10 == 0).alias("category"))


def q_team_names(spark, d):
    """The first two teams of a text."""
    text = F.concat(F.lit("SWE - "), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" x USA - "), F.col("n_name"))).otherwise(""))
    red, yellow = first_teams(text)
    return table(spark, d, "nation").select("n_nationkey", red.alias("red"), yellow.alias("yellow"))


def q_file_names(spark, d):
    """stems and changed suffixes of paths made from part keys."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("/a.b/c"), k.cast("string"), F.when(k % 3 == 0, ".png").when(k % 3 == 1, ".tar.gz").otherwise(""))
    return table(spark, d, "part").select("p_partkey", stem(path).alias("stem"), with_suffix(path, ".txt").alias("label"))


QUERIES = {"event_category": q_event_category, "team_names": q_team_names, "file_names": q_file_names}
ORACLE_SQL = {
    "event_category": """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'wmcc' WHEN 1 THEN 'wwcc' WHEN 2 THEN 'wjcc' ELSE 'owg' END || CAST(1990 + p_partkey % 35 AS VARCHAR) || '_Results' || CASE p_partkey % 3 WHEN 0 THEN '_men' WHEN 1 THEN '_Women' ELSE '' END || '.pdf' AS f FROM part),
n AS (SELECT p_partkey, upper(split_part(f, '_', 1)) || CASE WHEN contains(lower(f), 'women') THEN 'Women' WHEN contains(lower(f), 'men') THEN 'Men' ELSE '' END AS n FROM f)
SELECT p_partkey, n AS event_name, TRY_CAST(nullif(regexp_extract(n, '[0-9]{4}'), '') AS INT) AS year, CASE WHEN p_partkey % 10 = 0 THEN 'MD' WHEN contains(n, 'WJCC') THEN CASE WHEN contains(n, 'Women') THEN 'Junior Women' WHEN contains(n, 'Men') THEN 'Junior Men' END
WHEN contains(n, 'Women') THEN 'Women' WHEN contains(n, 'Men') THEN 'Men' WHEN contains(n, 'WMCC') THEN 'Men' WHEN contains(n, 'WWCC') THEN 'Women' END AS category FROM n""",
    "team_names": r"""SELECT n_nationkey, f[1] AS red, f[2] AS yellow FROM (SELECT n_nationkey, regexp_extract_all('SWE - ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' x USA - ' || n_name ELSE '' END, '\b[A-Z]{3} - [^\s\n]+\b') AS f FROM nation)""",
    "file_names": """SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'c' || p_partkey || '.tar' ELSE 'c' || p_partkey END AS stem, '/a.b/c' || p_partkey || CASE p_partkey % 3 WHEN 1 THEN '.tar' ELSE '' END || '.txt' AS label FROM part""",
}
