"""Miniature tables of court records, for operators whose columns the driver's tables lack; the same rows in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

_TYPES = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


class Mini:
    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows
        self.fields = [f.split() for f in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """The table as a common table expression."""
        rows = ", ".join("(" + ", ".join(f"CAST({_literal(v)} AS {_TYPES[t]})" for v, (_, t) in zip(r, self.fields, strict=True)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(n for n, _ in self.fields)}) AS (VALUES {rows})"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, dt.date):
        return f"'{v.isoformat()}'"
    return str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"


def ctes(*tables: Mini) -> str:
    return ", ".join(t.sql() for t in tables)


_D = dt.date

COURTS = Mini("courts", "id string, short_name string, full_name string, jurisdiction string", [
    ("ca1", "1st", "Court of Appeals for the First Circuit", "F"), ("nyapp", "NY", "New York Court of Appeals", "S"), ("txca", "TX", "Texas court of appeals", "SA"), ("coho", "CO", "Cherokee Court of Appeals", "TRA"),
    ("terr", "T", "Virgin Islands Court of Appeals", "TA"), ("caaf", "AF", "Court of Appeals for the Armed Forces", "MA"), ("cavc", "VC", "Court of Appeals for Veterans Claims", "FS"), ("eca", "E", "Emergency Court of Appeals", "F"),
    ("ccpa", "CC", "Court of Customs and Patent Appeals", "F"), ("intl", "I", "Court of Appeals of Nowhere", "I"), ("cadc", "DC", "Court of Appeals for the D.C. Circuit", "F"), ("nojur", "N", "Court of Appeals, Unknown", None),
    ("scotus", "S. Ct.", "Supreme Court", "F"), ("nysd", "SDNY", "District Court", "FD"), ("bk", "B", "Bankruptcy Court", "FB"), ("nysup", "NYS", "Supreme Court, New York County", "ST"),
])

PERSONS = Mini("persons", "id int, fjc_id int, name_first string, name_middle string, name_last string, gender string", [
    (1, 11, "Amalya", "Lyle", "Kearse", "f"), (2, 12, "Betty", "Binns", "Fletcher", "f"), (3, 13, "William", "A.", "Fletcher", "m"), (4, None, "Dorothy", "Wright", "Nelson", "f"), (5, None, "John", " ", "Smith", "m"),
    (6, None, "Jane", None, "Smith", "f"), (7, None, "Ellsworth", None, "Van Graafeiland", "m"), (8, None, "Edward", None, "Carnes", "m"), (9, None, "No", None, "Gender", None), (10, 20, "Harlington", None, "Wood", "m"),
    (11, None, "Mary", None, "District", "f"), (12, None, "Paul", None, "Jones", "m"), (13, None, "Pat", None, "Jones", "m"),
])
POSITIONS = Mini("positions", "person_id int, court_id string, position_type string, date_start date, date_termination date, date_retirement date", [
    (1, "ca2", "jud", _D(1979, 6, 1), None, None), (2, "ca9", "jud", _D(1979, 9, 1), _D(2012, 10, 1), None), (3, "ca9", "jud", _D(1998, 10, 1), None, None), (4, "ca9", "jud", _D(1979, 12, 1), None, None),
    (5, "ca1", "jud", _D(1970, 1, 1), _D(1980, 1, 1), None), (6, "ca1", "ret-senior-jud", _D(1990, 1, 1), None, None), (6, "ca3", "c-jus", _D(1985, 1, 1), _D(1989, 1, 1), None), (7, "ca2", "jud", _D(1974, 1, 1), None, _D(1985, 1, 1)),
    (8, "ca11", "jud", None, None, None), (9, "ca1", "jud", _D(1990, 1, 1), None, None), (10, "ca7", "jud", _D(1976, 1, 1), None, None), (11, "nysd", "jud", _D(1990, 1, 1), None, None), (12, "ca4", "jud", _D(1990, 1, 1), None, None),
    (13, "ca4", "jud", _D(2001, 1, 1), None, None), (1, "nysd", "pres", _D(1960, 1, 1), _D(1961, 1, 1), None), (5, "ca1", "jud", _D(1965, 1, 1), None, None), (None, "ca1", "jud", _D(1990, 1, 1), None, None), (5, None, "jud", _D(1910, 1, 1), None, None),
])
BIO = Mini("bio", "nid int, jid int, first_name string, middle_name string, last_name string, gender string", [
    (101, 11, "Amalya", "L.", "Kearse", "f"), (102, 12, "Betty", "B.", "Fletcher", "f"), (110, 30, "Learned", None, "Hand", "m"), (111, 31, "Augustus", "Noble", "Hand", "m"), (112, 32, "Ann", None, "Blank", " "), (113, 33, "Ruth", None, None, "f"),
])
SERVICE = Mini("service", "nid int, court_name string, commission_date date, termination_date date", [
    (101, "Second Circuit", _D(1979, 6, 1), None), (102, "First Circuit", _D(1979, 1, 1), None), (110, "Second Circuit", _D(1924, 12, 1), _D(1961, 8, 1)), (111, "Second Circuit", _D(1927, 5, 1), _D(1954, 10, 1)),
    (112, "First Circuit", None, None), (113, "First Circuit", None, None), (110, "Unmapped", _D(1909, 1, 1), None),
])
COURT_MAP = Mini("court_map", "court_id string, fjc_court_name string", [("ca1", "First Circuit"), ("ca2", "Second Circuit")])
SUPPLEMENT = Mini("supplement", "sup_id int, name_first string, name_middle string, name_last string, gender string, court_id string, start_date date, end_date date", [(1, "Amy", None, "St. Eve", "f", "ca7", _D(2018, 5, 1), None)])
POOL = (PERSONS, POSITIONS, BIO, SERVICE, COURT_MAP, SUPPLEMENT)
AFFILIATIONS = Mini("affiliations", "id int, person_id int, political_party string, date_start date, date_end date", [
    (1, 1, "d", _D(1975, 1, 1), _D(1985, 1, 1)), (2, 1, "r", _D(1985, 1, 1), None), (3, 2, "d", None, None), (4, 5, "r", _D(1990, 1, 1), None), (5, 6, "i", _D(1990, 1, 1), _D(1995, 1, 1)), (6, 6, " ", None, None), (7, 7, "w", _D(1970, 1, 1), None),
    (8, 7, "w", _D(1970, 1, 1), None), (9, 10, "", None, None), (10, None, "d", None, None), (11, 4, "d", None, None), (12, 4, "d", _D(1980, 1, 1), None), (13, 3, "x", _D(1990, 1, 1), None),
])

#: Opinions from 1960 on: court, year, author tag and marked-up text.
OPINIONS = Mini("opinions", "opinion_id int, court_id string, year_filed int, author_id int, author_str string, xml_harvard string, html_with_citations string", [
    (1, "ca2", 1985, None, None, "<opinion><author id=\"a1\">12 <b>KEARSE</b>, Circuit Judge:</author><p>x</p></opinion>", None),
    (2, "ca9", 1990, None, None, "<author>B. FLETCHER, Circuit Judge</author>", "<p>Before: FLETCHER and NELSON, Circuit Judges.</p><p>x</p>"),
    (3, "ca9", 1990, None, None, "<author>D.W. NELSON, Senior Circuit Judge</author>", None),
    (4, "ca1", 1975, None, None, "<author>John Smith Circuit Judge</author>", None),
    (5, "ca1", 1985, None, None, "<author>SMITH, Circuit Judge.</author>", None),
    (6, "ca1", 1995, None, None, "<author>PER CURIAM.</author>", "<div>Opinion by Judge Smith.</div>"),
    (7, "ca3", 1987, None, None, "<author>JONES, CIRCUIT JUDGE</author>", "<p>Before: X, Y</p><p>1</p><p>2</p><p>SMITH, Circuit Judge.</p>"),
    (8, "ca4", 2005, None, None, "<author>Jones, Chief Judge</author>", None),
    (9, "ca2", 1930, None, None, "<author>AUGUSTUS N. HAND, Circuit Judge</author>", None),
    (10, "ca2", 1930, None, None, "<author>L. HAND, Circuit Judge</author>", None),
    (11, "ca5", 1990, None, None, "<author>Wood, Jr., Circuit Judge</author>", None),
    (12, "ca5", 1990, None, None, "<author>Opinion filed by Judge X, Circuit Judge</author>", None),
    (13, "ca5", 1990, 5, "Smith", "<author>Nobody Here, Circuit Judge &amp; others</author>", "<?xml version='1'?><p>HARLINGTON WOOD, Jr., Senior Circuit Judge. The facts</p>"),
    (14, "ca9", 1999, None, None, None, "<pre class=\"inline\">\nW. FLETCHER, Circuit Judge:\n  text</pre>"),
    (15, "ca9", 1999, None, None, None, "<pre class=\"inline\">\nSMITH, District Judge:\n  text</pre>"),
    (16, "ca2", 1978, None, None, None, "<p>VAN GRAAFEILAND, Circuit Judge:</p>"),
    (17, "ca7", 1980, None, None, None, "<p>WOOD, Jr., Circuit Judge.</p>"),
    (18, "ca7", 2019, None, None, None, "<p>ST. EVE, Circuit Judge. Text goes on</p>"),
    (19, "ca11", 2000, None, None, None, "<p>ED CARNES, Chief Judge: text</p>"),
    (20, "ca2", 1985, None, None, None, "<p>Before: A, B</p><p>1</p><p>2</p><p>3</p><p>4</p><p>5</p><p>KEARSE, Circuit Judge:</p>"),
    (21, "ca2", 1985, None, None, None, "<div class=\"x\">Opinion by AMALYA LYLE KEARSE, Chief Circuit Judge</div><div>SMITH, Circuit Judge:</div>"),
    (22, "ca2", 1985, None, None, None, "<p>Judge Kearse delivered the opinion of the court</p>"),
    (23, "ca2", 1985, None, None, None, "<p class=\"indent\">Intro</p><p>OPINION</p> <p class=\"indent\">KEARSE, Circuit Judge:</p>"),
    (24, "ca2", 1985, None, None, None, "<p class=\"indent\">JOHN SMITH, Senior Judge.</p><p class=\"indent\">x</p>"),
    (25, "ca2", 1955, None, None, None, "<p>KEARSE, Circuit Judge:</p>"),
    (26, "ca8", 2003, None, None, None, "<p>SMITH and JONES, Circuit Judge:</p><br/>PER CURIAM, Circuit Judge:"),
    (27, "ca8", 2003, None, None, None, "<p>JONES, Circuit Judge:</p>"),
    (28, "ca8", 1972, None, "No Match", None, "<p>  opinion by chief judge kearse  </p>"),
    (29, "ca8", 1999, None, " ", "<author></author>", "  "),
    (30, "ca8", 1999, None, None, "<p>no tag</p>", "<p>nothing here</p>"),
    (31, "ca1", 1995, None, None, "<author>*1 J. Smith, Associate Justice</author><x/><author>two</author>", None),
    (32, "ca6", 2001, None, None, None, "<p>MARY DISTRICT, District Judge.</p>"),
    (33, "ca6", 2001, None, None, None, "<p>Opinion by Judge W. A. Fletcher: the court</p>"),
])

#: Raw case records of two snapshots; columns in the order of the normaliser.
_RAW = "circuit string, docket string, dktdate string, judgdate string, reopen string, appellan string, appellee string, apptype string, agency string, juris string, nos string, offense string, othtype string, disp string, outcome string, opinion string, tapeyear string"


def _record(circuit, docket, judged, appellant="A", appellee="B", kind="3", agency=None, nos="110", offense=None, disp="1", outcome="1", filed="01/02/2000"):
    return (circuit, docket, filed, judged, None, appellant, appellee, kind, agency, "1", nos, offense, None, disp, outcome, "1", "2001")


OLD = Mini("old_raw", _RAW, [
    ("CIRCUIT", "DOCKET", "x", "x", *["x"] * 13), _record("1", "1500001", "03/01/2000"), _record("1", "1500001", "03/01/2000", outcome="2"), _record("2", "1500002", "03/08/2000", " ", "D"), _record("2", "1500002", "04/30/2000", "C", "D"),
    _record("13", "1500009", "03/01/2000"), _record("01", "1500008", "03/01/2000"), _record(None, "1500007", "03/01/2000"), _record("3", "1500003", "3/1/2000", kind="8", offense="8720"), _record("4", "1500004", "04/15/2000", kind="1", agency="NLRB"),
    _record("4", "1500005", "13/45/2000", kind="6"), _record("0", "1500006", "05/20/2000", kind="9", disp="9", outcome="77"),
])
NEW = Mini("new_raw", _RAW, [_record("5", "901234", "03/01/2010", kind="5", offense="1000"), _record("5", "901234", "03/03/2010", "E", "F"), _record("5", "901235", " ", kind="4", nos="440"), _record("9", "6500001", "02/01/1965")])
DOCKETS = Mini("docket_opinions", "opinion_id int, cluster_id int, docket_id int, court_id string, docket_number string, opinion_date date", [
    (1, 1, 1, "ca1", "15-1", _D(2000, 3, 1)), (2, 2, 1, "ca2", "No. 15-2", _D(2000, 3, 5)), (3, 3, 2, "ca3", "15-3", _D(2000, 3, 1)), (4, 3, 2, "ca4", "15-4", _D(2000, 3, 20)), (5, 4, 3, "ca4", "15-5", _D(2000, 3, 1)),
    (6, 5, 3, "cadc", "1163, Docket 15-6", _D(2000, 3, 1)), (7, 6, 4, "ca5", "09-1234", _D(2010, 3, 2)), (8, 6, 4, "ca5", "Docket No. 09-1235", _D(2010, 3, 2)), (9, 7, 5, "ca9", "65-1", _D(1965, 2, 1)), (10, 8, 5, "ca9", "docket: 65-1", _D(1965, 2, 1)),
    (11, 9, 6, "ca9", "No 15-1", _D(2000, 1, 1)), (12, 9, 6, "ca1", "99-9", None), (13, 10, 7, "ca5", "09-1234", _D(2010, 3, 3)), (14, 11, 8, "ca2", "15-2", _D(1999, 1, 1)),
])
OUTCOMES = Mini("outcome_codes", "outcome_code string, outcome_label string, outcome_class string", [("1", "affirmed_or_enforced", "affirmed"), ("2", "reversed_or_vacated", "reversed")])
DISPOSITIONS = Mini("disposition_codes", "disposition_code string, disposition_label string", [("1", "merits_after_oral_hearing")])
DOMAINS = Mini("domain_codes", "code_kind string, code_value string, rq2_domain string, note string", [("nature_of_suit", "110", "contract", None), ("nature_of_suit", "440", "civil_rights", None), ("agency", "NLRB", "labor", None), ("agency", "110", "wrong", None)])

ENDINGS = Mini("endings", "id int, plain_text string, html_with_citations string, outcome_code string, disposition_code string", [
    (1, "Long text. We therefore affirm the judgment.", None, "1", "1"), (2, "The judgment is REVERSED and the case is remanded.", None, "2", "1"), (3, "AFFIRMED IN PART, REVERSED IN PART and remanded.", None, "3", "2"),
    (4, None, "<p>The appeal is dismissed as\n frivolous.</p>", "5", "1"), (5, "", "<b>We remand for further proceedings.</b>", "6", "3"), (6, "The petition for review is denied.", None, "2", "1"), (7, "A certificate of appealability is denied.", None, "9", "1"),
    (8, "Nothing said.", None, "1", "1"), (9, None, None, "1", "1"), (10, "AFFIRMED. 12", None, "2", "4"), (11, "We deny the petition and grant nothing.", None, "7", "1"), (12, "affirmed in part by one court, and vacated in part", None, "1", "1"),
    (13, "The order is vacated.", None, "1", "1"), (14, "We dismiss the appeal. COA denied", None, "6", "1"), (15, "Reversal was sought; we affirm", None, "-8", "5"), (16, "The case is remanded to the district court.", None, "1", "1"), (17, "x", None, "8", None),
    (18, "dismissed", None, "5", "2"), (19, "The decision below is enforced in part; in part it is reversed. We affirm and reverse.", None, "3", "1"),
])

CLUSTERS = Mini("clusters", "cluster_id int, docket_id int, date_filed date, source string, precedential_status string", [
    (1, 1, _D(1949, 1, 1), "C", "Published"), (2, 1, _D(1950, 1, 1), "CU", "Published"), (3, 2, _D(2010, 12, 31), "ZG", "Unpublished"), (4, 3, _D(2011, 1, 1), "U", ""), (5, 4, _D(2012, 1, 1), "R", "Published"), (6, 4, _D(2027, 1, 1), "C", None),
    (7, 3, None, "C", "Published"), (8, 5, _D(1960, 5, 5), None, "Published"), (9, 6, _D(2015, 5, 5), "G", "Published"),
])
CASE_DOCKETS = Mini("case_dockets", "id int, court_id string, source int", [(1, "scotus", 0), (2, "ca1", 1), (3, "nysd", 3), (4, "nysup", 2), (5, "nyapp", 8), (6, "ca1", 9)])
CITED = Mini("cited", "cluster_id int, n int", [(2, 5), (3, 6), (8, 21), (9, 400)])


def citations() -> tuple[Mini, Mini]:
    """Opinions of the clusters, and an edge for each of their citations."""
    owned = Mini("cluster_opinions", "opinion_id int, cluster_id int", [(10 * r[0] + k, r[0]) for r in CLUSTERS.rows for k in (0, 1)])
    edges = [(1000 + i, 10 * c + i % 2) for c, n in CITED.rows for i in range(n)]
    return owned, Mini("edges", "citing_opinion_id int, cited_opinion_id int", edges)
