import csv
import json
import random

import pytest

from pyspark.sql import functions as F

from leadloom.sources import files, split, split_json


@pytest.fixture()
def small_splits(spark, request):
    """Small byte splits, of 4,000 bytes unless said otherwise, so that small files make many."""
    names = {"spark.sql.files.maxPartitionBytes": str(getattr(request, "param", 4000)), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def quoted_rows(n):
    """Quotes, line breaks of both kinds, blank lines inside fields, and a few fields longer than three splits."""
    rng = random.Random(1)
    texts = ["plain", 'with "quotes" in', "multi\nline\n\ntext", "crlf\r\nin", "", "a,b", "é日本", " padded "]
    return [[str(i), "x\n" * 4000 if i % 400 == 7 else rng.choice(texts), str(i * 3)] for i in range(900)]


@pytest.mark.parametrize("broadcast", [split.BROADCAST_SPLITS, 0])
def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path, small_splits, monkeypatch, broadcast):
    monkeypatch.setattr(split, "BROADCAST_SPLITS", broadcast)
    rows = quoted_rows(900)
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text", "n"], *rows])
    with open(tmp_path / "b.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\r\n", quoting=csv.QUOTE_ALL).writerows([["id", "text", "n"], *rows[:60]])
    assert split.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    got, headers = files.read_csv(spark, str(tmp_path), same_header=True, dense_index=True)
    assert headers == [["id", "text", "n"]]
    found = [(r["c0"], r["c1"] or "", r["c2"]) for r in got.collect()]
    assert sorted(found) == sorted((a, b, c) for a, b, c in [*rows, *rows[:60]])
    assert sorted(r["row_id"] for r in got.collect()) == list(range(960))
    one_file, _ = files.read_csv(spark, str(tmp_path / "a.csv"), dense_index=True)
    assert [r["c0"] for r in one_file.orderBy("row_id").collect()] == [str(i) for i in range(900)]


def test_files_of_different_headers_and_edges(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('\n\r\nCompany,Email\r\n"A ""x""\nLtd",a@example.com\r\n\r\nshort\r\n')
    (tmp_path / "b.csv").write_text("email,company,more\nb@example.com,B,1,too,many\n")
    (tmp_path / "c.csv").write_text("company\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text('company\n"never closed\nmore')
    got = files.read_leads(spark, str(tmp_path), "csv").collect()
    assert {(r["company_name"], r["email"], r["reject_reason"]) for r in got} >= {('A "x"\nLtd', "a@example.com", None), ("short", None, None), ("B", "b@example.com", None)}
    assert len(got) == 4 and len({r["row_id"] for r in got}) == 4


def test_only_cut_splits_are_read_for_pieces(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("id,n\n" + "".join(f"{i},{i}\n" for i in range(4000)))
    states = split.quote_states(split.read_lines(spark, str(tmp_path)))
    assert states.count() > 5 and states.where("_open OR _ends_open").count() == 0


def json_texts():
    """Lists and enveloped lists whose strings look like structure, records longer than splits, and files that are no JSON or hold no list."""
    rng = random.Random(1)
    odd = [1, 2.5, None, True, "plain", 'q"uote', "b\\ack", '}{][,"', "é日本", '\\"}', '","leads":[', {"a": {"b": [1, {"leads": [1]}]}}, [1, [2, {"data": []}]], {}, []]

    def value():
        return "x" * rng.choice([3, 40, 5000]) if rng.random() < 0.05 else rng.choice(odd)

    records = [{"company": f"c{i}", "v": value(), "w": value()} if rng.random() < 0.8 else value() for i in range(300)]
    envelope = {"meta": {"data": [1], "x": value()}, "n": [1, 2], "leads": records, "z": {"leads": 1}}
    return {
        "root": (json.dumps(records), records), "pretty": (json.dumps(records, indent=2) + "\n", records), "envelope": (json.dumps(envelope), records),
        "later key": (json.dumps({"items": records[:200], "data": records[200:], "x": records[:50]}), records[200:]),
        "not a list": (json.dumps({"leads": {"a": 1}, "results": records[:9]}, ensure_ascii=False, indent=1) + "\n\n", records[:9]),
        "strings": (json.dumps(["a}b", "c}", "}", 1, None, "x" * 3000 + "}", "y}"] * 20), ["a}b", "c}", "}", 1, None, "x" * 3000 + "}", "y}"] * 20),
        "empty": ("[]", []), "empty member": ('{"leads": []}\n', []), "blanks": ('  \n [ {"k":1} , {"k":2} ]  \n ', [{"k": 1}, {"k": 2}]),
        "cut": (json.dumps(records)[:-1], None), "cut member": ('{"leads":[]', None), "extra": ("[]}", None), "two roots": ("[1][2]", None), "open string": ('["open', None),
        "no comma": ('[{"a":1}{"b":2}]', None), "two commas": ('[{"a":1},,{"b":2}]', None), "last comma": ('[{"a":1},]', None), "broken record": ('[{"a":1},{"b":x}]', None),
        "key twice": ('{"leads":[1],"leads":[2]}', None), "scalar": ("7", None), "no list": ('{"none":[1]}', None), "mark": ('﻿[{"a":1}]', None),
    }


@pytest.mark.parametrize(("small_splits", "broadcast"), [(8_000, split.BROADCAST_SPLITS), (8_000, 0)], indirect=["small_splits"])
def test_one_json_list_is_read_by_many_tasks(spark, tmp_path, small_splits, monkeypatch, broadcast):
    monkeypatch.setattr(split_json, "BROADCAST_SPLITS", broadcast)
    texts = json_texts() if broadcast else {n: t for n, t in json_texts().items() if n in ("root", "envelope", "no comma", "two commas", "last comma", "broken record")}
    for name, (text, _) in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    assert split_json.read_pieces(spark, str(tmp_path / "root.json"))[0].rdd.getNumPartitions() > 5
    records, unsound = split_json.json_elements(spark, str(tmp_path))
    name_of = F.regexp_extract(F.url_decode("_file"), r"/([^/]+)\.json$", 1).alias("name")
    got = {}
    for r in records.select(name_of, "_kind", "_at", "value").orderBy("_at").collect():
        try:
            got.setdefault(r["name"], []).append(json.loads(r["value"]))
        except json.JSONDecodeError:
            got.setdefault(r["name"], []).append(split_json)  # equal to no record
    refused = {r["name"] for r in unsound.select(name_of).collect()}
    broken = {"no comma", "two commas", "last comma", "broken record"}  # found when records are parsed
    assert refused | broken == {n for n, (_, want) in texts.items() if want is None}
    for name, (_, want) in texts.items():
        if want is not None:
            assert got.get(name, []) == want, name
    roots = files.read_json_file(spark, str(tmp_path))
    assert roots.where("bad_root").count() == sum(want is None for _, want in texts.values())
    assert roots.where("NOT bad_root").count() == sum(len(want) for _, want in texts.values() if want is not None)


def test_leads_of_json_and_listing_files(spark, tmp_path, small_splits):
    leads = [{"company": f"Company {i}", "note": "}" * (i % 50)} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps({"x": leads[:10], "data": leads}))
    (tmp_path / "b.json").write_text("{}")
    got = files.read_leads(spark, str(tmp_path / "*.json"), "json", dense_index=True).collect()
    assert sorted(r["row_id"] for r in got if r["row_id"] is not None) == list(range(400))
    assert [r["reject_reason"] for r in got if r["row_id"] is None] == ["invalid_json_root"]
    assert {r["company_name"] for r in got if r["row_id"] is not None} == {x["company"] for x in leads}
    (tmp_path / "c.json").write_text(json.dumps({"leadList": [{"agency_name": x["company"]} for x in leads]}))
    listed = files.read_leads(spark, str(tmp_path / "c.json"), "listing").orderBy("row_id").collect()
    assert [r["company_name"] for r in listed] == [x["company"] for x in leads]
