"""Which raw column names mean the same attribute, and the target schema of each table."""

from __future__ import annotations

# Attribute -> the names senders use for it.
NAMES = {
    "report_id": ["report_id", "isr", "primaryid", "primary_id", "safetyreportid", "safety_report_id",
                  "rpt_no", "report_no", "report_number", "reportid", "isr_no", "isr_number"],
    "case_id": ["case_id", "case", "caseid", "case_no", "case_number", "case_num"],
    "caseversion": ["caseversion", "case_version", "version"],
    "i_f_cod": ["i_f_cod", "i_f_code"],
    "event_dt": ["event_dt", "event_date"],
    "fda_dt": ["fda_dt", "receiptdate", "receipt_date", "receipt_dt"],
    "init_fda_dt": ["init_fda_dt"],
    "rept_cod": ["rept_cod", "rept_code"],
    "mfr_num": ["mfr_num", "mfr_no"],
    "mfr_sndr": ["mfr_sndr", "mfr_sender"],
    "age": ["age"],
    "age_cod": ["age_cod", "age_unit", "age_code"],
    "age_grp": ["age_grp", "age_group"],
    "sex": ["sex", "gndr_cod", "gender", "patient_sex", "gender_code"],
    "occr_country": ["occr_country", "country_occ", "occurcountry", "event_country", "occur_country"],
    "reporter_country": ["reporter_country"],
    "auth_num": ["auth_num"],
    "lit_ref": ["lit_ref"],
    "image": ["image"],
    "confid": ["confid"],
    "foll_seq": ["foll_seq"],
    "drug_seq": ["drug_seq"],
    "role_cod": ["role_cod", "role_code"],
    "drugname": ["drugname", "drug_name", "medicinalproduct", "medicinal_product"],
    "prod_ai": ["prod_ai"],
    "route": ["route"],
    "dose_vbm": ["dose_vbm"],
    "dose_amt": ["dose_amt"],
    "dose_unit": ["dose_unit"],
    "lot_num": ["lot_num", "lot_nbr", "batch", "lot_no", "lot_number", "batch_no"],
    "nda_num": ["nda_num"],
    "dechal": ["dechal"],
    "exp_dt": ["exp_dt"],
    "outc_cod": ["outc_cod", "outc_code", "outcome", "pt_outcome", "patient_outcome"],
}

#: raw name -> attribute
ATTRIBUTE = {name: attribute for attribute, names in NAMES.items() for name in names}

# The columns each table ends with, and their types.
SCHEMA = {
    "demo": {"report_id": "bigint", "case_id": "bigint", "caseversion": "int", "i_f_cod": "string",
             "event_dt": "string", "fda_dt": "string", "rept_cod": "string", "mfr_num": "string",
             "mfr_sndr": "string", "age": "double", "age_cod": "string", "sex": "string",
             "occr_country": "string", "reporter_country": "string"},
    "drug": {"report_id": "bigint", "case_id": "bigint", "drug_seq": "int", "role_cod": "string",
             "drugname": "string", "prod_ai": "string", "route": "string", "dose_vbm": "string",
             "lot_num": "string"},
    "outc": {"report_id": "bigint", "case_id": "bigint", "outc_cod": "string"},
}


def attribute(name: str) -> str:
    """The attribute a cleaned raw name stands for; an unknown name stands for itself."""
    return ATTRIBUTE.get(name, name)
