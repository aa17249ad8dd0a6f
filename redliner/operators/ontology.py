"""Clause categories, the stakeholders they concern, and the parties a text names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redliner.functions import text as T

#: Categories in order with keywords and stakeholders; the list is a parameter of the operators.
CATEGORIES = [
    ("Document Name", [], ["Both parties"]),
    ("Parties", ["by and between", "entered into"], ["Both parties"]),
    ("Agreement Date", ["dated as of", "entered into on"], ["Both parties"]),
    ("Effective Date", ["effective date"], ["Both parties"]),
    ("Expiration Date", ["expire", "expiration", "remain in effect", "term of this agreement"], ["Both parties"]),
    ("Renewal Term", ["renew", "renewal"], ["Both parties"]),
    ("Notice Period To Terminate Renewal", ["non-renewal", "notice of termination prior to"], ["Both parties"]),
    ("Governing Law", ["governed by", "laws of the state", "jurisdiction", "governing law", "venue"], ["Both parties"]),
    ("Most Favored Nation", ["most favored", "no less favorable"], ["Customers", "Licensee / buyer"]),
    ("Non-Compete", ["compete", "competing", "non-compete", "competitive business"], ["Employees", "Both parties"]),
    ("Exclusivity", ["exclusive", "exclusively", "sole provider", "sole supplier"], ["Vendors / suppliers", "Licensee / buyer"]),
    ("No-Solicit Of Customers", ["solicit any customer", "solicit customers", "solicitation of customers"], ["Customers", "Both parties"]),
    ("Competitive Restriction Exception", ["shall not apply to", "notwithstanding the foregoing"], ["Both parties"]),
    ("No-Solicit Of Employees", ["solicit", "hire any employee", "employees of the other party"], ["Employees", "Both parties"]),
    ("Non-Disparagement", ["disparage", "disparaging"], ["Both parties", "Employees"]),
    ("Termination For Convenience", ["for convenience", "without cause", "terminate this agreement"], ["Both parties"]),
    ("Rofr/Rofo/Rofn", ["right of first refusal", "right of first offer", "right of first negotiation"], ["Both parties", "Third parties"]),
    ("Change Of Control", ["change of control", "change in control", "merger", "acquisition of"], ["Investors / acquirers", "Both parties"]),
    ("Anti-Assignment", ["assign", "assignment", "transfer this agreement"], ["Both parties", "Third parties"]),
    ("Revenue/Profit Sharing", ["revenue share", "profit share", "net revenue", "royalt"], ["Licensor / provider", "Licensee / buyer"]),
    ("Price Restrictions", ["price increase", "increase the price", "pricing"], ["Customers", "Licensee / buyer"]),
    ("Minimum Commitment", ["minimum purchase", "minimum commitment", "minimum guarantee", "minimum order"], ["Licensee / buyer", "Licensor / provider"]),
    ("Volume Restriction", ["up to", "maximum number", "shall not exceed", "workstations", "seats"], ["Licensee / buyer"]),
    ("Ip Ownership Assignment", ["intellectual property", "shall own", "assigns all right", "title and interest"], ["Licensor / provider", "Licensee / buyer"]),
    ("Joint Ip Ownership", ["jointly own", "joint ownership", "jointly developed"], ["Both parties"]),
    ("License Grant", ["grants", "hereby grant", "license to use", "licence to use"], ["Licensee / buyer", "Licensor / provider"]),
    ("Non-Transferable License", ["non-transferable", "nontransferable", "non-assignable"], ["Licensee / buyer"]),
    ("Affiliate License-Licensor", ["licensor and its affiliates", "licensor's affiliates"], ["Licensor / provider", "Affiliates / subsidiaries"]),
    ("Affiliate License-Licensee", ["sublicense", "subsidiaries", "licensee's affiliates", "its affiliates"], ["Licensee / buyer", "Affiliates / subsidiaries"]),
    ("Unlimited/All-You-Can-Eat-License", ["unlimited", "enterprise-wide", "enterprise wide"], ["Licensee / buyer"]),
    ("Irrevocable Or Perpetual License", ["irrevocable", "perpetual"], ["Licensee / buyer", "Licensor / provider"]),
    ("Source Code Escrow", ["escrow", "source code"], ["Licensee / buyer", "Licensor / provider"]),
    ("Post-Termination Services", ["after termination", "following termination", "transition services", "upon termination"], ["Customers", "Licensee / buyer"]),
    ("Audit Rights", ["audit", "inspect", "books and records"], ["Licensor / provider", "Licensee / buyer"]),
    ("Uncapped Liability", ["unlimited liability", "gross negligence", "willful misconduct"], ["Both parties"]),
    ("Cap On Liability", ["liability shall not exceed", "total liability", "aggregate liability", "in no event shall", "liable for"], ["Both parties"]),
    ("Liquidated Damages", ["liquidated damages"], ["Both parties"]),
    ("Warranty Duration", ["warrant", "warranty"], ["Licensee / buyer", "Customers"]),
    ("Insurance", ["insurance", "insured"], ["Both parties", "Insurers"]),
    ("Covenant Not To Sue", ["not to sue", "covenant not to"], ["Both parties"]),
    ("Third Party Beneficiary", ["third party beneficiar", "third-party beneficiar"], ["Third parties"]),
]
#: Words that name a party.
ROLES = [
    "licensor", "licensee", "sublicensee", "company", "employer", "employee", "customer", "client", "vendor", "supplier", "distributor",
    "reseller", "contractor", "subcontractor", "consultant", "buyer", "seller", "purchaser", "provider", "service provider", "user", "member",
    "partner", "lender", "borrower", "landlord", "tenant", "franchisor", "franchisee", "agent", "manufacturer", "affiliate", "subsidiary",
    "subsidiaries", "third party", "third parties", "shareholder", "investor",
]
#: Phrases for all parties, and pieces of company names that name nobody.
BOTH_PARTIES = r"(?i)\b(?:each|either|neither|both)\s+part(?:y|ies)\b|\bthe\s+parties\b"
BOTH = "Both parties"
FRAGMENTS = ["inc", "llc", "ltd", "corp", "co", "plc", "gmbh", "sa", "nv", "bv", "pvt"]


#: Signs around a name, words before it, and ways to say all parties.
NAME_SIGNS, NAME_EDGES, NAME_ARTICLES = r"[\[\]<>{}*\"“”]", r"^[ .,;:\-]+|[ .,;:\-]+$", r"(?i)^(?:the|all|any|its|their)\s+"
ALL_PARTIES = r"(?i)^(?:both|each|either|neither|all|the)?\s*part(?:y|ies)(?:\s+involved)?$"


def load_ontology(spark: SparkSession, path: str) -> list[tuple[str, list[str], list[str]]]:
    """Categories of a JSON file ``{category: {"keywords": [...], "stakeholders": [...]}}``, in its order; a small table of rules, read once."""
    import json

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return [(name, list(x.get("keywords", [])), list(x.get("stakeholders", []))) for name, x in json.loads(text).items()]


def ontology(spark: SparkSession, categories=CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(c, i, k, s) for i, (c, k, s) in enumerate(categories)], "category string, ord int, keywords array<string>, stakeholders array<string>")


def detect_categories(texts: DataFrame, id_col: str, k: int = 3, text_col: str = "text", categories=CATEGORIES) -> DataFrame:
    """``(id, category, ord, hits, rank)``: the ``k`` categories with most keywords in the text, ties in order.  One pass, no join: the list is a constant."""
    rows = texts.select(F.col(id_col), T.normalize_text(F.lower(F.col(text_col))).alias("__low")).select(id_col, F.posexplode(_best(F.col("__low"), k, categories)).alias("pos", "c"))
    return rows.select(id_col, F.col("c.category").alias("category"), F.col("c.ord").alias("ord"), (-F.col("c.minus_hits")).alias("hits"), (F.col("pos") + 1).alias("rank"))


def _best(low: Column, k: int, categories) -> Column:
    """The ``k`` categories with most keywords in a lower-cased text, in order."""
    found = []
    for i, (name, keywords, _) in enumerate(categories):
        if keywords:
            hits = sum((F.contains(low, F.lit(w)).cast("int") for w in keywords), F.lit(0))
            found.append(F.struct((-hits).alias("minus_hits"), F.lit(i).alias("ord"), F.lit(name).alias("category")))
    return F.slice(F.array_sort(F.filter(F.array(*found), lambda x: x["minus_hits"] < 0)), 1, k)


def with_categories(rows: DataFrame, text: Column, k: int = 3, categories=CATEGORIES) -> DataFrame:
    """``rows`` with the ``categories`` of a text and their ``stakeholders``, each once in the order of first mention: ``detect_categories`` and
    ``stakeholders_for`` of each row, without an exchange."""
    of = F.create_map(*[x for c, _, who in categories for x in (F.lit(c), F.array(*[F.lit(w) for w in who]).cast("array<string>"))])
    rows = rows.withColumn("__low", T.normalize_text(F.lower(text)))
    rows = rows.withColumn("categories", F.transform(_best(F.col("__low"), k, categories), lambda c: c["category"])).drop("__low")
    return rows.withColumn("stakeholders", F.array_distinct(F.flatten(F.transform("categories", lambda c: F.element_at(of, c)))))


def stakeholders_for(detected: DataFrame, id_col: str, onto: DataFrame) -> DataFrame:
    """``(id, stakeholder, pos)``: stakeholders of the categories, each once, in the order of first mention."""
    rows = detected.join(F.broadcast(onto.select("category", F.posexplode("stakeholders").alias("n", "stakeholder"))), "category")
    first = rows.groupBy(id_col, "stakeholder").agg(F.min(F.struct("rank", "n")).alias("first"))
    return first.select(id_col, "stakeholder", F.row_number().over(Window.partitionBy(id_col).orderBy("first")).alias("pos"))


def find_parties(text: Column) -> Column:
    """Roles the text names as whole words, in the list's order, then both parties."""

    def found(x: Column) -> Column:  # a pattern is sought only where its word is in the text
        low = x["low"]
        named = [F.when(F.contains(low, F.lit(r)) & low.rlike(rf"\b{r}(?:s|es)?\b"), F.lit(r.title())) for r in ROLES]
        both = F.when(F.contains(low, F.lit("part")) & x["text"].rlike(BOTH_PARTIES), F.lit(BOTH))
        return F.filter(F.array(*named, both), lambda y: y.isNotNull())

    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), found)[0]


def contract_parties(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """The roles named in each document's first clause."""
    first = chunks.groupBy(key).agg(F.min_by("text", "ordinal").alias("text"))
    return first.select(key, F.array_remove(find_parties(F.col("text")), BOTH).alias("parties"))


def singular(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when(low.endswith("ies") & (F.length(word) > 4), F.concat(F.expr("''"), F.regexp_replace(word, "(?i)ies$", "y")))
        .when(low.endswith("s") & ~low.endswith("ss") & (F.length(word) > 3), F.regexp_replace(word, "(?i)s$", ""))
        .otherwise(word)
    )


def normalize_party(name: Column) -> Column:
    """A clean party name; null for fragments that name nobody."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_SIGNS, ""), NAME_EDGES, "")
    bare = F.regexp_replace(bare, NAME_ARTICLES, "")
    left = F.regexp_extract(bare, r"^(.*?)\s*(?:/|$)", 1)
    one = F.when(~left.rlike(r"\S\s+\S"), singular(left)).otherwise(left)
    shown = F.when((one == F.lower(one)) & (one != F.upper(one)), F.concat(F.upper(F.substring(one, 1, 1)), F.expr("''"), one.substr(F.lit(2), F.length(one)))).otherwise(one)
    return (
        F.when(bare == "", F.lit(None).cast("string"))
        .when(bare.rlike(ALL_PARTIES), F.lit(BOTH))
        .when(F.regexp_replace(F.lower(left), r"^\.+|\.+$", "").isin(FRAGMENTS), F.lit(None).cast("string"))
        .otherwise(shown)
    )


def normalize_parties(names: Column) -> Column:
    """Clean names, each once, in order; fragments go."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), normalize_party), lambda x: x.isNotNull()))
