"""Words around substance names: salts, forms, units, placeholders."""

from __future__ import annotations

import re

# Trailing words that name a salt, ester or hydrate.
SALTS = [
    "HYDROCHLORIDE", "HCL", "HYDROBROMIDE", "HYDROIODIDE", "SODIUM", "DISODIUM", "POTASSIUM", "DIPOTASSIUM",
    "CALCIUM", "MAGNESIUM", "SULFATE", "SULPHATE", "PHOSPHATE", "DIPHOSPHATE", "TARTRATE", "BITARTRATE", "MALEATE",
    "FUMARATE", "SUCCINATE", "CITRATE", "ACETATE", "MESYLATE", "MESILATE", "BESYLATE", "BESILATE", "TOSYLATE",
    "NITRATE", "BROMIDE", "IODIDE", "LACTATE", "GLUCONATE", "CARBONATE", "OXALATE", "PAMOATE", "EMBONATE",
    "XINAFOATE", "FUROATE", "VALERATE", "PROPIONATE", "DIPROPIONATE", "ENANTATE", "ENANTHATE", "DECANOATE",
    "PALMITATE", "STEARATE", "BENZOATE", "TROMETHAMINE", "MEGLUMINE", "OLAMINE", "DIOLAMINE", "MONOHYDRATE",
    "DIHYDRATE", "TRIHYDRATE", "HEMIHYDRATE", "HYDRATE", "ANHYDROUS", "MICRONIZED", "MICRONISED", "CHLORIDE",
    "BICARBONATE", "FLUORIDE",
]

# Compounds whose salt word is part of the substance's usual name.
SALT_COMPOUNDS = [
    "SODIUM CHLORIDE", "SODIUM BICARBONATE", "SODIUM CITRATE", "SODIUM PHOSPHATE", "SODIUM ACETATE",
    "SODIUM SULFATE", "SODIUM LACTATE", "SODIUM FLUORIDE", "POTASSIUM CHLORIDE", "POTASSIUM CITRATE",
    "POTASSIUM PHOSPHATE", "POTASSIUM ACETATE", "POTASSIUM BICARBONATE", "POTASSIUM IODIDE", "CALCIUM CARBONATE",
    "CALCIUM CHLORIDE", "CALCIUM ACETATE", "CALCIUM CITRATE", "CALCIUM GLUCONATE", "CALCIUM LACTATE",
    "CALCIUM PHOSPHATE", "MAGNESIUM SULFATE", "MAGNESIUM SULPHATE", "MAGNESIUM CHLORIDE", "MAGNESIUM CITRATE",
    "MAGNESIUM CARBONATE", "MAGNESIUM LACTATE", "FERROUS SULFATE", "FERROUS SULPHATE", "FERROUS GLUCONATE",
    "FERROUS FUMARATE", "ZINC SULFATE", "ZINC ACETATE", "ZINC GLUCONATE", "ZINC CHLORIDE", "AMMONIUM CHLORIDE",
    "AMMONIUM LACTATE", "BARIUM SULFATE",
]

# Dose forms and release forms.
FORMS = [
    "TABLET", "TABLETS", "TAB", "TABS", "CAPSULE", "CAPSULES", "CAP", "CAPS", "CAPLET", "CAPLETS", "INJECTION",
    "INJECTABLE", "SOLUTION", "SUSPENSION", "SYRUP", "CREAM", "OINTMENT", "GEL", "PATCH", "SPRAY", "INHALER",
    "DISKUS", "PEN", "VIAL", "AMPOULE", "AMPULE", "SYRINGE", "KIT", "PACK", "POWDER", "GRANULES", "DROPS", "LOTION",
    "FOAM", "SHAMPOO", "SUPPOSITORY", "ELIXIR", "CONCENTRATE", "EMULSION", "AEROSOL", "IMPLANT", "PATCHES",
    "PREFILLED", "ORAL", "TOPICAL", "IV", "SC", "IM", "XL", "XR", "SR", "ER", "CR", "LA", "SRT", "MR", "ODT", "DS",
    "HFA",
]

# Units of doses.
UNITS = ["MG", "MCG", "UG", "G", "GM", "ML", "L", "IU", "IE", "U", "MEQ", "MMOL", "KG", "MGML"]
DOSE_UNITS = ["MG", "MCG", "UG", "G", "GM", "ML", "L", "IU", "IE", "U", "%", "MEQ", "MMOL", "KG"]

# Further words in names that are no part of the substance.
EXTRA_FORMS = ["FILM", "COATED", "FILM-COATED", "RETARD", "FORTE", "GENERIC", "NOS", "BRAND", "DAILY", "HARD", "SOFT"]

# Texts that stand where a name is missing.
PLACEHOLDERS = [
    "UNKNOWN", "UNK", "NA", "N/A", "N.A.", "NONE", "NOT KNOWN", "NOT APPLICABLE", "NOT REPORTED", "UNSPECIFIED",
    "NO DRUG NAME GIVEN", "NO DRUG NAME", "UNKNOWN DRUG", "STUDY DRUG", "BLINDED", "BLINDED STUDY PRODUCT",
    "DRUG NAME UNKNOWN", "UNKNOWN MEDICATION", "OTHER", "NOS", "PLACEBO", "?", "??", "-", "--", ".", "00000", "NULL",
    "XXX", "TBD", "PENDING", "UNKNOWN INGREDIENT", "UNKNOWN SUBSTANCE", "MEDICATION", "DRUG", "STUDY MEDICATION",
]

STRENGTH = re.compile(
    r"[0-9]+(?:[.,][0-9]+)?\s*(?:MG|MCG|UG|GM|G|ML|L|IU|IE|U|%|MEQ|MMOL|KG)?(?:\s*/\s*[0-9]*(?:[.,][0-9]+)?\s*(?:MG|MCG|UG|GM|G|ML|L|IU|IE|U|%|MEQ|MMOL|KG|H|DAY|HR)?)?"
)
_PLACEHOLDER_SET = set(PLACEHOLDERS)
_SALT_SET = set(SALTS)


def is_placeholder(text: str) -> bool:
    """True for a normalised text that names no drug."""
    return text in _PLACEHOLDER_SET or not any(c.isalpha() for c in text)


def is_strength(text: str) -> bool:
    return STRENGTH.fullmatch(text) is not None


def is_salt(text: str) -> bool:
    """True for a normalised text of nothing but salt words."""
    words = text.split(" ")
    return bool(words[0]) and all(w in _SALT_SET for w in words)


def without_salts(text: str) -> str:
    """The normalised text without salt words at its end."""
    words = text.split(" ")
    while len(words) > 1 and words[-1] in _SALT_SET:
        words.pop()
    return " ".join(words)
