"""Contact quality of a lead."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leadloom import constants as K
from leadloom.functions.contacts import PhoneRules, check_email, check_phone
from leadloom.functions.text import let, struct
from leadloom.operators.normalize import replace_columns


def verification(email: str, phone: str, phone_region: str | PhoneRules = K.DEFAULT_PHONE_REGION) -> str:
    """STRUCT<email: STRUCT<valid, normalized, reason, is_disposable>, phone: STRUCT<valid, normalized, reason>>."""
    both = struct(e=check_email(email), p=check_phone(phone, phone_region))
    return let(
        "ve", both,
        struct(
            email=struct(valid="ve.e.valid", normalized="ve.e.value", reason="ve.e.reason",
                         is_disposable="ve.e.is_disposable"),
            phone=struct(valid="ve.p.valid", normalized="ve.p.value", reason="ve.p.reason"),
        ),
    )


def contact_quality(email_ok: str, phone_ok: str) -> str:
    return f"CASE WHEN {email_ok} AND {phone_ok} THEN 'verified' WHEN {email_ok} OR {phone_ok} THEN 'likely' ELSE 'low' END"


def verify_leads(leads: DataFrame, phone_region: str | PhoneRules = K.DEFAULT_PHONE_REGION) -> DataFrame:
    """Add `verification` and `contact_quality`."""
    checked = replace_columns(leads, {"verification": verification("email", "phone", phone_region)})
    return replace_columns(
        checked, {"contact_quality": contact_quality("verification.email.valid", "verification.phone.valid")}
    )
