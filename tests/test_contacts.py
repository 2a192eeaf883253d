import pytest

from leadloom.functions.contacts import PhoneRules, check_email, check_phone
from leadloom.operators.verify import verify_leads
from tests.helpers import leads, one


@pytest.mark.parametrize(
    "phone,value,reason",
    [
        ("+27825550199", "+27825550199", "valid_e164"),
        ("082 555 0199", "+27825550199", "valid_e164"),
        ("27825550199", "+27825550199", "valid_e164"),
        ("+27 (0)82 555 0199", "+27825550199", "valid_e164"),
        ("0027825550199", "+27825550199", "valid_e164"),
        ("082 555 0199 ext 12", "+27825550199", "valid_e164"),
        ("044 001 0004", "+27440010004", "valid_e164"),
        ("+14155552671", "+14155552671", "valid_e164"),
        ("+442071838750", "+442071838750", "valid_e164"),
        ("+493012345678", "+493012345678", "valid_e164"),
        ("+61412345678", "+61412345678", "valid_e164"),
        ("+919876543210", "+919876543210", "valid_e164"),
        ("+5511987654321", "+5511987654321", "valid_e164"),
        ("+33142222222", "+33142222222", "valid_e164"),
        ("+819012345678", "+819012345678", "valid_e164"),
        ("+525512345678", "+525512345678", "valid_e164"),
        ("+2348012345678", "+2348012345678", "valid_e164"),
        ("12", None, "invalid_number"),
        ("1234567", None, "invalid_number"),
        ("+39 06 698 12345", "+390669812345", "valid_e164"),
        ("+31 (0)20 624 1111", "+31206241111", "valid_e164"),
        ("+353 1 234 5678", "+35312345678", "valid_e164"),
        ("+86 10 8888 8888", "+861088888888", "valid_e164"),
        ("+7 (8)495 123 45 67", "+74951234567", "valid_e164"),
        ("00 351 21 123 4567", "+351211234567", "valid_e164"),
        ("+34 12345", None, "invalid_number"),
        ("+45 1234 56789", None, "invalid_number"),
        ("+999 1234 5678", "+99912345678", "fallback_normalized"),
        ("abc", None, "invalid_digits"),
        ("  ", None, "empty_phone"),
        (None, None, "empty_phone"),
    ],
)
def test_phone(spark, phone, value, reason):
    got = one(spark, check_phone("p"), p=phone)
    assert (got["value"], got["reason"], got["valid"]) == (value, reason, value is not None)


@pytest.mark.parametrize(
    "phone,value",
    [
        # assigned, by hand
        ("+1 212 555 0123", "+12125550123"), ("+1 989-555-0123", "+19895550123"), ("+44 28 9012 3456", "+442890123456"), ("+61 2 9876 5432", "+61298765432"),
        ("+61 1300 123 456", "+611300123456"), ("+55 (0)91 3234-5678", "+559132345678"), ("+55 91 91234-5678", "+5591912345678"), ("+49 171 1234567", "+491711234567"),
        ("+86 138 0013 8000", "+8613800138000"), ("+254 (0)712 345 678", "+254712345678"), ("+41 44 668 18 00", "+41446681800"), ("+65 6123 4567", "+6561234567"),
        ("+27 60 123 4567", "+27601234567"), ("+32 470 12 34 56", "+32470123456"), ("+972 (0)50-123-4567", "+972501234567"),
        # in no range, or of another length than their range has
        ("+1 211 555 0123", None), ("+1 199 555 0123", None), ("+1 371 555 0123", None), ("+1 212 155 0123", None), ("+1 212 555 012", None), ("+44 25 9012 3456", None),
        ("+61 1301 123 456", None), ("+55 91 81234-5678", None), ("+55 91 9123-4567", None), ("+86 118 0013 8000", None), ("+27 52 123 4567", None), ("+32 47 12 34 56", None),
        ("+351 5 1234 5678", None), ("+65 2123 4567", None), ("+27 (0)90 123 4567", None),
    ],
)
def test_phone_ranges(spark, phone, value):
    got = one(spark, check_phone("p"), p=phone)
    assert (got["value"], got["reason"]) == (value, "valid_e164" if value else "invalid_number")


def test_phone_plans_are_an_argument(spark):
    rules = PhoneRules("XA", (("XA", "999", "0", "00", "12-13:5-6 15:8"), ("XB", "1", "", "00", "20-21,30/4-5:7")))
    ask = check_phone("p", rules)
    for phone, value in [("012 345", "+99912345"), ("0134567", "+999134567"), ("14567", None), ("+999 15 123456", "+99915123456"), ("00 1 21 4 1234", "+12141234"), ("+1 22 4 1234", None)]:
        assert one(spark, ask, p=phone)["value"] == value, phone
    assert one(spark, ask, p="+27825550199")["reason"] == "fallback_normalized"
    with pytest.raises(ValueError, match="overlap"):
        check_phone("p", PhoneRules("XA", (("XA", "9", "0", "00", "1-3:5 25:6"),)))


def test_phone_region_is_an_option(spark):
    assert one(spark, check_phone("p", "GB"), p="020 7183 8750")["value"] == "+442071838750"
    with pytest.raises(ValueError):
        check_phone("p", "XX")


@pytest.mark.parametrize(
    "email,value,reason,quality",
    [
        (" Ann@Example.com ", "ann@example.com", "valid_email", "high"),
        ("info@example.com", "info@example.com", "valid_email", "medium"),
        ("burn@mailinator.com", None, "disposable_domain", "low"),
        ("not-an-email", None, "invalid_format", "low"),
        ("@@@", None, "invalid_format", "low"),
        (None, None, "empty_email", "low"),
    ],
)
def test_email(spark, email, value, reason, quality):
    got = one(spark, check_email("e"), e=email)
    assert (got["value"], got["reason"], got["quality"]) == (value, reason, quality)


def test_contact_quality_table(spark):
    table = [
        ("a@example.com", "+27825550199", "verified"), ("a@example.com", None, "likely"), (None, "+27825550198", "likely"),
        ("burn@mailinator.com", "+27825550197", "likely"), ("not-an-email", None, "low"), (None, None, "low"),
        ("a@example.com", "+14155552671", "verified"), ("@@@", "12", "low"),
    ]
    graded = verify_leads(leads(spark, *[{"email": e, "phone": p} for e, p, _ in table])).orderBy("row_id").collect()
    assert [r["contact_quality"] for r in graded] == [q for *_, q in table]
    assert graded[3]["verification"]["email"]["is_disposable"] is True
