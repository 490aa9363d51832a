"""Column layouts shared by the whole engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule parameters, one typed column each; a rule type uses the ones named in RULE_VALUES.
PARAM_TYPES = {
    "maximum_distance": "int",
    "minimum_similarity": "double",
    "match_percent_threshold": "double",
    "soundex_type": "string",
    "max_code_length": "int",
    "metaphone_type": "string",
    "strict": "boolean",
    "char_subset": "string",
    "custom_char_subset": "string",
    "case_sensitive": "boolean",
    "pattern": "string",
    "address": "string",
}

# Rule types, the keys each accepts, which are required, and defaults.
RULE_VALUES: dict[str, dict[str, object]] = {
    "levenshtein": {"maximum_distance": ...},
    "levenshtein_substring": {"maximum_distance": ...},
    "hamming": {"maximum_distance": ...},
    "confusables": {},
    "damerau_levenshtein": {"maximum_distance": ...},
    "damerau_levenshtein_substring": {"maximum_distance": ...},
    "jaccard": {"minimum_similarity": ...},
    "jaro": {"match_percent_threshold": ...},
    "jaro_winkler": {"match_percent_threshold": ...},
    "soundex": {"minimum_similarity": ..., "soundex_type": "normal"},
    "metaphone": {"max_code_length": 4, "metaphone_type": "normal"},
    "nysiis": {"strict": True},
    "match_rating": {},
    "bitflip": {"char_subset": "dns", "custom_char_subset": "", "case_sensitive": True},
    "regex": {"pattern": ...},
    "cidr": {"address": ...},
}
CHOICES = {
    "soundex_type": ["normal", "refined"],
    "metaphone_type": ["normal", "double"],
    "char_subset": ["dns", "printable", "custom"],
}
# Rule types whose "values" object may be left out.
VALUES_OPTIONAL = ["bitflip", "confusables", "match_rating"]

STEP_TYPE = (
    "struct<preprocessor_type:string,ignore_tld:boolean,exclusion_set_source:string,list:array<string>,"
    "path:string,regex:boolean,encode:boolean,decode:boolean,keep_both:boolean>"
)

RULE_COLUMNS = [
    "group_source", "group_ord", "group_name", "set_ord", "rule_set", "set_id", "target", "chain_id",
    "rule_idx", "rule_type", "exit_on_match", *PARAM_TYPES, "rule_values",
]

# What a rule job says about a (part, rule) pair, besides the pair itself.
RESULT_TYPES = {
    "match": "boolean",
    "distance": "int",
    "substring": "string",
    "match_percent": "double",
    "similarity": "double",
    "primary_code": "string",
    "alternate_code": "string",
    "encoded": "string",
    "metadata": "string",  # JSON object text of a user-defined rule
    "error": "string",
}
# Rule-side columns a result row keeps: they name the rule and are needed to write its metadata.
KEPT_RULE_COLUMNS = [
    "set_id", "rule_idx", "rule_type", "exit_on_match", "soundex_type", "max_code_length", "metaphone_type",
]
PAIR_KEY = ["chain_id", "part", "set_id", "rule_idx"]
RESULT_COLUMNS = ["chain_id", "part", *KEPT_RULE_COLUMNS, *RESULT_TYPES]

# Part columns made by the preprocessors.
PART_METADATA = {"split_string": "string", "split_position": "int", "punycode": "boolean"}


def result_columns(**found: Column) -> list[Column]:
    """All result columns, NULL where a rule type says nothing."""
    return [
        (found[name] if name in found else F.lit(None)).cast(kind).alias(name)
        for name, kind in RESULT_TYPES.items()
    ]
