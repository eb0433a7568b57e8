from pyspark.sql import functions as F

from lumenbib.llm import names as N

ALIKE = [
    ("Robert Vosbevich", "Vosbevich R"), ("Robert Vosbevich", "R. Vosbevich"), ("Robert Vosbevich", "Dr Robest Vosbevich"), ("Robert Vosbevich", "Vosbevich Robert"), ("Sam Zelrin", "SAMUEL T. ZELRIN"),
    ("Karl-Heinz Nymnasen", "Nymnasen K-H"), ("Søren Møkivist", "Soeren Moekivist"), ("Lucía M. Penbeda", "Penbeda, Lucía"), ("Nélequist-Brüault, T.", "Theodora NélequistBrüault"), ("K. de Brümileh", "Kenji de Brümileh"), ("Wenmitamann U", "Ulrich Weenmitamann"), ("EŁ Ulmvigo", "Ekaterina Ł. Ulmvigo"),
    ("Robert J. Oppenheimer", "J. Robert Oppenheimer"), ("J. Robert Oppenheimer", "Robert Oppenheimer"), ("Anna Maria Kowalska", "Maria Kowalska"), ("Liz Gray", "Elizabeth Grey"), ("Elisabeth Garlesezdae", "Elisabeth Garlesezade"), ("Ulrich Belkizae", "Ulrich Belkizade"),
    ("Jorbemann MS", "Margaret S. Jorbemann"), ("Thalrastowick K-HJ", "Karl-Heinz J. Thalrastowick"), ("Inês Bruevirazade", "Inês Brüvirazdae"), ("Cholé Kärbeson", "Chloé Kärbesoon"), ("Margaret Jones MD", "M. Jones"),
]
UNLIKE = [("Robert Vosbevich", "Paul Vosbevich"), ("John B. Smith", "John E. Smith"), ("Pavel Raslusto", "Pavel Sterraault"), ("Dmitri S. Falmisto", "Dmitri Šemgono"), ("", "x"), (None, None), ("van Kiski, A.", "Kiski, A."), ("L. Gray", "Elizabeth Grey"), ("L. Gray", "L. Grey"), ("Anna M. Kowalska", "Maria Kowalska"), ("Dr", "Mr"), ("Elizabeth Jean Jorstobewick", "Jean-Luc Jorstobewick")]


def test_persons():
    for a, b in ALIKE:
        assert N.persons_alike(a, b) and N.persons_alike(b, a), (a, b)
        assert set(N.person_forms(a)) & set(N.person_forms(b)), (a, b)
    for a, b in UNLIKE:
        assert not N.persons_alike(a, b), (a, b)


def test_organisations():
    full = "Meburunu Institute of Ecology"
    for x in ["MEBURUNU INSTITUTE OF ECOLOGY", "Institute of Ecology, Meburunu", "Meburunu-Institute of Ecology", "Meburunu Inst. of Ecology", "Meburunu Institute of Ecology, NO", "Insitute of Ecology at Meburunu", "MIE (Meburunu)", "MIE Meburunu", "MIE", "meburunu  institute of ecology"]:
        assert N.orgs_alike(full, x), x
        assert set(N.org_forms(full)) & set(N.org_forms(x)), x
    for x in ["Meburunu Institute of Physics", "Lekumiro Institute of Ecology", "MIP", "MIE (Lekumiro)", "", None]:
        assert not N.orgs_alike(full, x), x


def test_slip():
    assert [N.slip(*p) for p in (("ab", "ab"), ("abc", "ac"), ("abc", "abd"), ("abcd", "abdc"), ("abc", "xyz"), ("a", "abc"))] == [0, 1, 1, 1, 2, 2]


def test_links(spark):
    org = [(1, "Meburunu Institute of Ecology", "0a0000023", "NO"), (2, "MIE", "https://ror.example/0A0000023", None), (3, "MIE", None, "NO"), (4, "Meburunu Institute of Ecology", None, "SE"), (5, "Inst. of Ecology Meburunu", None, "NO"), (6, None, None, None), (7, "", "0a0000023", "NO"), (8, "Meburunu Institute of Physics", "0a0000023", "NO")]
    i = spark.createDataFrame(org, "institution_id bigint, display_name string, ror string, country_code string").withColumn("node", F.lit(1)).withColumn("entity", F.lit("e"))
    aut = [
        (1, "Robert Vosbevich", "0099-0000-0012-0347", None), (2, "Vosbevich R", "https://orcid.example/0099000000120347", 1), (3, "R. Vosbevich", None, 5), (4, "Robert Vosbevich", None, 4), (5, "Paul Kim", "0099-0000-0012-0347", 1),
        (6, "Robert Vosbevich", "0000-0000-0000-0000", None), (7, "Robert Vosbevich", "0000-0000-0000-0000", 99), (8, None, None, 1), (9, "", "", 1), (10, "R. Vosbevich", None, 5),
    ]
    a = spark.createDataFrame(aut, "author_id bigint, display_name string, orcid string, institution_id bigint").withColumn("name", F.lit("n")).withColumn("org", F.lit(3))
    got = {tuple(r) for r in N.found(a, i).collect()}
    assert {x[1:] for x in got if x[0] == "institution"} == {(1, 2), (1, 5), (2, 5)}
    assert {x[1:] for x in got if x[0] == "author"} == {(x, y) for x in (1, 2, 3, 10) for y in (1, 2, 3, 10) if x < y}
    assert N.found(a.limit(0), i.limit(0)).collect() == []


def test_hot_name(spark):
    rows = [(k, "Robert Vosbevich" if k % 3 else f"Ann Kess{k}", None, 1) for k in range(600)]
    a = spark.createDataFrame(rows, "author_id bigint, display_name string, orcid string, institution_id bigint")
    orgs = spark.createDataFrame([(1, 1)], "institution_id bigint, entity bigint")
    links = N.link_authors(a, orgs)
    assert links.groupBy("entity").count().orderBy(F.desc("count")).first()["count"] == 400


def test_rarity_decides_on_partial_forms(spark):
    forms = [(1, False, n) for n in range(65)] + [(2, False, 1), (2, False, 2), (3, True, 7), (3, True, 8)] + [(4, True, n) for n in range(100, 180)] + [(5, False, 9)]
    df = spark.createDataFrame(forms, "key bigint, whole boolean, node bigint")
    got = {(r["a"], r["b"]): r["score"] for r in N._candidates(df).collect()}
    assert got[1, 2] == 0.5 and got[7, 8] == 0.5 and len(got) == 2 + 80 * 79 // 2 and got[100, 179] == 1 / 80
    # a crowd of 70 initials is no evidence; whole names are, and so is a partial form beside it
    rows = [(k, f"Smith, R. {chr(65 + k % 26)}. {chr(65 + k // 26)}.", None, 1) for k in range(70)] + [(100, "Rosalind Smith", None, 1), (101, "Smith, Rosalind", None, 1), (102, "Rosalind Zelwick", None, 1), (103, "R. Zelwick", None, 1)]
    a = spark.createDataFrame(rows, "author_id bigint, display_name string, orcid string, institution_id bigint")
    links = {r["author_id"]: r["entity"] for r in N.link_authors(a, spark.createDataFrame([(1, 1)], "institution_id bigint, entity bigint")).collect()}
    assert links[100] == links[101] == 100 and links[102] == links[103] == 102 and len({links[k] for k in range(70)}) == 70


def test_no_pair_of_a_crowd_is_left_out(spark):
    # 70 spellings of one person, as many namesakes by initials in one organisation, and records of three of these
    rows = [(k, f"{'' if k % 2 else 'Dr '}Zelwick{'' if k < 2 else chr(95 + k // 2)}, R.", None, 1) for k in range(50)] + [(50 + k, "Zelwick, R.", f"0000-0001-0000-{k:03}1", 1) for k in range(30)]
    rows += [(100 + k, f"Smith, R. {chr(65 + k % 26)}. {chr(65 + k // 26)}.", None, 1) for k in range(70)] + [(200, "Rosalind A. A. Smith", None, 1), (201, "Roland C. B. Smith", None, 1), (202, "Smith RC B", None, 1)]
    a = spark.createDataFrame(rows, "author_id bigint, display_name string, orcid string, institution_id bigint")
    links = {r["author_id"]: r["entity"] for r in N.link_authors(a, spark.createDataFrame([(1, 1)], "institution_id bigint, entity bigint")).collect()}
    assert {links[k] for k in range(80)} == {0}
    assert links[200] == links[100] and links[201] == links[202] == links[128] and len({links[k] for k in range(100, 170)}) == 70
    # 80 organisations of one short form
    rows = [(k, "Meburunu Institute of Ecology", f"0a00000{k:02}", None) for k in range(80)] + [(100 + k, "MIE (Meburunu)", f"0a00000{k:02}", None) for k in range(80)]
    i = spark.createDataFrame(rows, "institution_id bigint, display_name string, ror string, country_code string")
    links = {r["institution_id"]: r["entity"] for r in N.link_institutions(i).collect()}
    assert all(links[k] == links[100 + k] == k for k in range(80))


def test_entities(spark):
    i = spark.createDataFrame([(1, "Meburunu University", None, None), (2, "University of Meburunu", None, None)], "institution_id bigint, display_name string, ror string, country_code string")
    a = spark.createDataFrame([(1, "Ann Kess", None, 1), (2, "A. Kess", None, 2), (3, None, None, None)], "author_id bigint, display_name string, orcid string, institution_id bigint")
    assert {tuple(r) for r in N.entities(a, i).collect()} == {("author", 1, 1, 2), ("author", 2, 1, 2), ("author", 3, 3, 1), ("institution", 1, 1, 2), ("institution", 2, 1, 2)}
