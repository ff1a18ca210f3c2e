"""Tables of the linkage engine: the raw register, its derived columns, and names used across modules."""

from __future__ import annotations

from pyspark.sql import types as T

# The register's file order.
RAW_COLUMNS = [
    "RECORD_IDENTIFIER", "CHANGE_TYPE", "PRO_ORDER", "UPRN", "UDPRN", "ORGANISATION_NAME", "DEPARTMENT_NAME", "SUB_BUILDING_NAME", "BUILDING_NAME",
    "BUILDING_NUMBER", "DEPENDENT_THOROUGHFARE", "THOROUGHFARE", "DOUBLE_DEPENDENT_LOCALITY", "DEPENDENT_LOCALITY", "POST_TOWN", "POSTCODE",
    "POSTCODE_TYPE", "DELIVERY_POINT_SUFFIX", "WELSH_DEPENDENT_THOROUGHFARE", "WELSH_THOROUGHFARE", "WELSH_DOUBLE_DEPENDENT_LOCALITY",
    "WELSH_DEPENDENT_LOCALITY", "WELSH_POST_TOWN", "PO_BOX_NUMBER", "PROCESS_DATE", "START_DATE", "END_DATE", "LAST_UPDATE_DATE", "ENTRY_DATE",
]
#: The ten text fields that addresses are aligned with, in order.
TEXT_FIELDS = [
    "ORGANISATION_NAME", "DEPARTMENT_NAME", "SUB_BUILDING_NAME", "BUILDING_NAME", "BUILDING_NUMBER", "DEPENDENT_THOROUGHFARE", "THOROUGHFARE",
    "DOUBLE_DEPENDENT_LOCALITY", "DEPENDENT_LOCALITY", "POST_TOWN",
]
ADDRESS_FIELDS = [*TEXT_FIELDS, "POSTCODE"]
MICRO_FIELDS = TEXT_FIELDS[:5]
MACRO_FIELDS = TEXT_FIELDS[5:9]
NUMBER_SLOTS = [f"number_like_{i}" for i in range(5)]
POSTCODE_PARTS = ["pc_area", "pc_district", "pc_sector", "pc_unit_0", "pc_unit_1"]
DERIVED_COLUMNS = ["ex_label", "n_tenement", "type_of_micro", "type_of_macro", *NUMBER_SLOTS, "pc0", "pc1", *POSTCODE_PARTS]
#: Record type of a delivery point in files that hold other records too.
DELIVERY_POINT = "28"


def raw_schema(names: list[str] | None = None) -> T.StructType:
    """All text, as in the files; `names` overrides the default columns."""
    return T.StructType([T.StructField(c, T.StringType()) for c in names or RAW_COLUMNS])
