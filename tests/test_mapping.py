import json

import pytest
from pyspark.sql import functions as F

from leadloom.operators.dedup import dedup_leads
from leadloom.operators.mapping import map_columns, map_records, rejected_rows, tag_rejects, valid_leads
from leadloom.operators.normalize import normalize_leads
from leadloom.settings import MappingOptions, NormalizeOptions
from leadloom.sources.files import read_leads, read_plain_csv
from tests.helpers import leads


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rejects_of(tagged):
    return sorted((r["row_index"], r["reason"]) for r in rejected_rows(tagged).collect())


def test_csv_aliases_rejects_and_quoting(spark, tmp_path):
    path = put(
        tmp_path, "in.csv",
        'Company , Agent,URL,contact_email,phone,town,province,lead_source\n'
        '"Acme, ""Best""\nRealty",Ann,https://acme.co.za,info@acme.co.za,+27825550199,George,WC,\n'
        '\n'
        ',Bob,,,,,,\nBad Mail,,,nope,,,,\nBad Phone,,,,12,,,\nBad Site,,no dots here,,,,,\nShort\n',
    )
    tagged = read_leads(spark, path, dense_index=True)
    good = valid_leads(tagged).orderBy("row_id").collect()
    assert [r["company_name"] for r in good] == ['Acme, "Best"\nRealty', "Short"]
    assert (good[0]["location"], good[0]["source"], good[0]["agent_name"]) == ("George", "input", "Ann")
    assert rejects_of(tagged) == [
        (1, "missing_required_identity"), (2, "invalid_email"), (3, "invalid_phone"), (4, "invalid_website"),
    ]


def test_csv_duplicate_header_last_wins(spark, tmp_path):
    path = put(tmp_path, "dup.csv", "company,Company\nfirst,second\n")
    assert read_leads(spark, path).first()["company_name"] == "second"


def test_csv_files_with_different_headers(spark, tmp_path):
    put(tmp_path, "a.csv", "company_name,email\nAlpha,a@x.co\n")
    put(tmp_path, "b.csv", "\nemail,phone,company\nb@x.co,+27825550199,Beta\n")
    put(tmp_path, "c.csv", "company_name,email\nGamma,c@x.co\n")
    for dense in (False, True):
        tagged = read_leads(spark, str(tmp_path), "csv", dense_index=dense)
        found = {(r["company_name"], r["email"], r["phone"]) for r in valid_leads(tagged).collect()}
        assert found == {("Alpha", "a@x.co", None), ("Beta", "b@x.co", "+27825550199"), ("Gamma", "c@x.co", None)}
        assert tagged.select("row_id").distinct().count() == 3
    plain = read_plain_csv(spark, str(tmp_path), ("email",))
    assert {tuple(r) for r in plain.select("email", "company", "company_name").collect()} == {
        ("a@x.co", None, "Alpha"), ("b@x.co", "Beta", None), ("c@x.co", None, "Gamma"),
    }
    with pytest.raises(ValueError, match="line break"):
        read_leads(spark, put(tmp_path, "d.csv", 'company,"a\nb"\nX,1\n'))


def test_csv_same_header_by_option(spark, tmp_path):
    path = put(tmp_path, "one.csv", "company,email\nAlpha,a@x.co\n")
    assert read_leads(spark, path, same_header=True).first()["email"] == "a@x.co"


def test_plain_csv_needs_its_columns(spark, tmp_path):
    assert read_plain_csv(spark, put(tmp_path, "a.csv", "company_name,x\nA,1\n")).first()["x"] == "1"
    with pytest.raises(ValueError, match="company_name"):
        read_plain_csv(spark, put(tmp_path, "b.csv", "company,x\nA,1\n"))


def test_presence_beats_value(spark):
    df = spark.createDataFrame([(0, " ", "Alias", 5)], "row_id int, company_name string, company string, phone int")
    row = map_columns(df).first()
    assert row["company_name"] is None and row["phone"] is None


RECORDS = [
    {"Company": " A ", "contact_email": "a@example.com", "phone": 123, "mobile": "0825550199"},
    {"company_name": "", "company": "B"},
    [1],
    {"AGENCY ": "C", "email": None, "mail": "c@example.com", "city": " ", "town": "T"},
    "text",
]
EXPECTED = [("A", "a@example.com", None, None), ("C", None, None, None)]


@pytest.mark.parametrize("shape", ["list", "leads", "items"])
def test_json_file(spark, tmp_path, shape):
    body = RECORDS if shape == "list" else {"data": 5, shape: RECORDS}
    tagged = read_leads(spark, put(tmp_path, "in.json", json.dumps(body)), dense_index=True)
    good = valid_leads(tagged).orderBy("row_id").collect()
    assert [(r["company_name"], r["email"], r["phone"], r["location"]) for r in good] == EXPECTED
    assert rejects_of(tagged) == [
        (1, "missing_required_identity"), (2, "invalid_record_type"), (4, "invalid_record_type"),
    ]


def test_json_lines_agree_with_json_file(spark, tmp_path):
    path = put(tmp_path, "in.jsonl", "\n".join(json.dumps(r) for r in RECORDS))
    good = valid_leads(read_leads(spark, path)).orderBy("row_id").collect()
    assert [(r["company_name"], r["email"], r["phone"], r["location"]) for r in good] == EXPECTED


@pytest.mark.parametrize("body", ['{"x": 1}', "7", "not json"])
def test_bad_root_is_one_reject(spark, tmp_path, body):
    path = put(tmp_path, "bad.json", body)
    assert rejects_of(read_leads(spark, path)) == [(None, "invalid_json_root")]
    assert rejects_of(read_leads(spark, path, "listing")) == [(None, "invalid_listing_root")]


def test_empty_list_has_no_rows(spark, tmp_path):
    assert read_leads(spark, put(tmp_path, "e.json", "[]")).count() == 0


def test_listing_export(spark, tmp_path):
    body = {"records": [
        {"agency_name": "Ag", "agent_name": "Ann", "agent_phone": "0825550199", "agent_email": "", "email": "e@x.co",
         "location": "Here", "listing_url": "https://l", "source_site": "portal", "price": 5.0},
        {"agent_name": "No Agency"}, 3,
    ]}
    tagged = read_leads(spark, put(tmp_path, "l.json", json.dumps(body)), " Listing ", dense_index=True)
    row = valid_leads(tagged).first()
    assert (row["company_name"], row["email"], row["source"]) == ("Ag", "e@x.co", "portal")
    assert row["location"] is None and row["website"] is None
    assert rejects_of(tagged) == [(1, "missing_required_identity"), (2, "invalid_record_type")]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported"):
        read_leads(spark, "/nowhere", "xml")


def test_relaxed_and_required_options(spark):
    df = spark.createDataFrame([(0, None, "nope", "12")], "row_id int, company string, email string, phone string")
    opts = MappingOptions(required_any=("email", "phone"), strict_contacts=False)
    assert rejects_of(tag_rejects(map_columns(df, opts), opts)) == []


def test_valid_plus_rejected_is_input(spark, sf):
    from workload.queries import tagged

    t = tagged(spark, sf)
    assert valid_leads(t).count() + rejected_rows(t).count() == t.count()


def test_dedup_precedence_and_first_seen(spark):
    df = normalize_leads(leads(
        spark,
        {"company_name": "Acme", "website": "https://www.acme.co.za/", "row_id": 7},
        {"company_name": "Other", "website": "ACME.co.za", "row_id": 3},
        {"company_name": "  acme ", "row_id": 4}, {"company_name": "ACME", "row_id": 5},
        {"email": "X@y.co", "row_id": 8}, {"email": "x@y.co ", "phone": "1", "row_id": 9},
        {"row_id": 10}, {"row_id": 11},
    ))
    assert sorted(r["row_id"] for r in dedup_leads(df).collect()) == [3, 4, 8, 10]


def test_dedup_is_idempotent_and_independent_of_layout(spark, sf):
    from workload.queries import normalized

    df = normalized(spark, sf)
    base = sorted(map(str, dedup_leads(df).collect()))
    assert sorted(map(str, dedup_leads(dedup_leads(df)).collect())) == base
    for shuffled in (df.repartition(1), df.repartition(50), df.orderBy(F.desc("row_id"))):
        assert sorted(map(str, dedup_leads(shuffled).collect())) == base


def test_website_key_options(spark):
    df = leads(spark, {"website": "https://www.wework.com/"})
    assert normalize_leads(df).first()["website"] == "ework.com"
    assert normalize_leads(df, NormalizeOptions(www="prefix")).first()["website"] == "wework.com"


def test_variant_key_clash_takes_last_name(spark):
    df = spark.sql("""SELECT 0 AS row_id, parse_json('{"Company":"big","company":"small"}') AS record""")
    assert map_records(df).first()["company_name"] == "small"


def test_dense_index_over_many_files(spark, tmp_path):
    for f in range(4):
        put(tmp_path, f"part-{f}.jsonl", "\n".join(json.dumps({"company": f"{f}-{i}"}) for i in range(5)))
    rows = read_leads(spark, str(tmp_path), "jsonl", dense_index=True).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(20))
    by_file = [[r["company_name"] for r in rows if r["company_name"].startswith(f"{f}-")] for f in range(4)]
    assert by_file == [[f"{f}-{i}" for i in range(5)] for f in range(4)]


def test_listing_fallbacks_pass_over_empty_values_only(spark, tmp_path):
    cases = [("", "b"), (None, "b"), (0, "b"), ([], "b"), (False, "b"), (7, None), ([1], None), ("x@y.co", "x@y.co")]
    body = [{"agency_name": "A", "agent_email": first, "email": "b"} for first, _ in cases]
    opts = MappingOptions(strict_contacts=False)
    rows = read_leads(spark, put(tmp_path, "l.json", json.dumps(body)), "listing", opts, dense_index=True).orderBy("row_id")
    assert [r["email"] for r in rows.collect()] == [want for _, want in cases]


def test_record_keys_lose_all_white_space(spark):
    rows = spark.createDataFrame([(0, json.dumps({"\t Company\n": "A"}))], "row_id bigint, t string").selectExpr("row_id", "try_parse_json(t) AS record")
    assert map_records(rows).first()["company_name"] == "A"


def test_defaults_that_are_no_text_or_false_are_kept(spark):
    rows = spark.createDataFrame([(0, "A", None)], "row_id bigint, company string, source string")
    got = map_columns(rows, MappingOptions(defaults={"source": 0, "has_chatbot": False, "location": " ", "phone": None})).first()
    assert (got["source"], got["has_chatbot"], got["location"], got["phone"]) == ("0", "False", None, None)
