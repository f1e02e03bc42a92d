"""Invented rules table used by the registered queries and the flagship job."""

# Invented rules for the part-name feed, in priority order. 'old bolt' is shadowed by the
# earlier 'bolt'; 'ol' is a two-letter keyword that matches inside words.
PART_RULES = {
    "Food": ["pizza", "hot plate"],
    "Petrol": ["fuel", "bolt", "ol"],
    "Person": ["old bolt", "ring"],
    "Grocery": ["gizmo", "red"],
    "Clothing": ["widget"],
    "Salon": ["rod"],
    "Hospital": ["anvil"],
    "Sports": ["gear"],
    "Rent": ["large plate"],
    "SIP": ["fund"],
    "Salary": ["payroll"],
    "Others": ["misc"],
}
