"""Field catalogues, header words, rules and thresholds.

These must equal the values of the applications whose results are matched.
"""

from __future__ import annotations

# ---- fields of a single table: name -> (label, type, header words) -------------------
SYSTEM_FIELDS = {
    "date": ("Data", "date", [
        "data", "date", "timestamp", "date time", "datetime", "dzień", "dzien", "datum", "created at",
        "operation date", "usage date", "data zużycia", "data zuzycia"]),
    "material": ("Materiał", "text", [
        "materiał", "material", "material name", "nazwa materiału", "nazwa materialu", "pack material",
        "packaging material", "item"]),
    "quantity": ("Zużycie / ilość wykorzystana", "number", [
        "ilość", "ilosc", "quantity", "qty", "used", "usage", "zużycie", "zuzycie", "consumption",
        "amount", "value"]),
    "stock_level": ("Aktualny stan zapasu", "number", [
        "stan zapasu", "stan magazynowy", "zapas", "stan końcowy", "stan koncowy", "stock", "stock level",
        "ending stock", "on hand", "quantity on hand", "saldo", "balance", "inventory", "stan"]),
    "brand": ("Marka", "text", ["marka", "brand", "brand name", "client brand", "client"]),
    "line": ("Linia / stanowisko", "text", [
        "linia", "line", "stanowisko", "station", "packing station", "pack station", "workstation",
        "area", "obszar"]),
    "material_code": ("Kod materiału", "text", [
        "kod materiału", "kod materialu", "material code", "item code", "article code", "article", "kod"]),
    "sku": ("SKU", "text", ["sku", "stock keeping unit", "product sku"]),
    "description": ("Opis", "text", ["opis", "description", "comment", "uwagi", "notes"]),
    "unit": ("Jednostka", "text", ["jednostka", "unit", "uom", "unit of measure", "miara"]),
    "shift": ("Zmiana", "text", ["zmiana", "shift", "schicht", "work shift"]),
    "operator": ("Operator", "text", ["operator", "pracownik", "employee", "user", "worker"]),
    "order": ("Zamówienie", "text", [
        "zamówienie", "zamowienie", "order", "order id", "order no", "order number", "zlecenie", "job"]),
    "record_id": ("ID rekordu / operacji", "text", [
        "record id", "operation id", "transaction id", "usage id", "event id", "row id", "id rekordu",
        "id operacji", "id transakcji"]),
    "packaging_type": ("Typ opakowania", "text", [
        "typ opakowania", "packaging type", "package type", "material type", "typ materiału",
        "typ materialu"]),
    "category": ("Kategoria", "text", ["kategoria", "category", "group", "grupa", "family"]),
}
REQUIRED_FIELDS = ["date", "material", "quantity"]
#: The catalogue's own identifier of a field, which also counts as a header word.
FIELD_IDS = {"stock_level": "stockLevel", "material_code": "materialCode", "record_id": "recordId",
             "packaging_type": "packagingType", "lead_time_days": "leadTimeDays",
             "minimum_order_quantity": "minimumOrderQuantity", "order_multiple": "orderMultiple",
             "safety_stock": "safetyStock", "open_orders": "openOrders"}
MATCH_THRESHOLD = 0.56

# ---- fields of the role tables: role -> name -> (type, required, header words) --------
_ITEM = ["materiał", "material", "material name", "nazwa materiału", "item", "article"]
_UNIT = ["jednostka", "unit", "uom"]
_CODE = ["kod materiału", "material code", "article", "item code"]
_LEAD = ["lead time", "lead time days", "czas dostawy"]
_SUPPLIER = ["dostawca", "supplier", "vendor"]
_SAFETY = ["safety stock", "zapas bezpieczeństwa", "zapas bezpieczenstwa"]
ROLE_FIELDS = {
    "usage": {
        "date": ("date", True, ["data", "date", "usage date", "data zużycia", "dzień"]),
        "material": ("text", False, _ITEM),
        "quantity": ("number", True, ["zużycie", "zuzycie", "usage", "consumption", "ilość", "ilosc",
                                      "quantity", "qty used"]),
        "unit": ("text", False, [*_UNIT, "unit of measure"]),
        "material_code": ("text", False, ["kod materiału", "material code", "article", "article code",
                                          "item code"]),
        "sku": ("text", False, ["sku", "stock keeping unit"]),
        "brand": ("text", False, ["marka", "brand"]),
        "category": ("text", False, ["kategoria", "category", "group"]),
        "line": ("text", False, ["linia", "line", "station", "stanowisko"]),
    },
    "stock": {
        "material": ("text", False, _ITEM),
        "stock_level": ("number", True, ["stan zapasu", "stan magazynowy", "zapas", "stock", "stock level",
                                         "on hand", "inventory", "balance", "saldo"]),
        "date": ("date", False, ["data stanu", "data snapshotu", "snapshot date", "stock date", "data",
                                 "date"]),
        "unit": ("text", False, _UNIT),
        "material_code": ("text", False, ["kod materiału", "material code", "article", "article code",
                                          "item code"]),
        "sku": ("text", False, ["sku"]),
        "lead_time_days": ("number", False, _LEAD),
        "minimum_order_quantity": ("number", False, ["moq", "minimum order quantity", "minimalna ilość"]),
        "order_multiple": ("number", False, ["order multiple", "krotność", "krotnosc", "pack multiple"]),
        "safety_stock": ("number", False, _SAFETY),
        "open_orders": ("number", False, ["open orders", "otwarte zamówienia", "w drodze", "on order"]),
        "supplier": ("text", False, _SUPPLIER),
    },
    "receipts": {
        "material": ("text", False, ["materiał", "material", "material name", "article", "item"]),
        "quantity": ("number", True, ["ilość przyjęta", "przyjęcie", "receipt quantity",
                                      "received quantity", "qty received", "ilość", "quantity", "qty"]),
        "date": ("date", True, ["data przyjęcia", "receipt date", "delivery date", "data dostawy", "data",
                                "date"]),
        "unit": ("text", False, _UNIT),
        "material_code": ("text", False, _CODE),
        "sku": ("text", False, ["sku"]),
        "supplier": ("text", False, _SUPPLIER),
        "order": ("text", False, ["zamówienie", "order", "order number", "ord/req number"]),
    },
    "orders": {
        "material": ("text", False, ["materiał", "material", "material name", "article", "item"]),
        "open_orders": ("number", True, ["otwarte zamówienia", "open orders", "open quantity",
                                         "remaining quantity", "pozostała ilość", "qty ordered",
                                         "quantity ordered"]),
        "date": ("date", False, ["planowana data", "expected date", "on site date", "delivery date",
                                 "data", "date"]),
        "unit": ("text", False, _UNIT),
        "material_code": ("text", False, _CODE),
        "sku": ("text", False, ["sku"]),
        "supplier": ("text", False, _SUPPLIER),
        "lead_time_days": ("number", False, _LEAD),
        "minimum_order_quantity": ("number", False, ["moq", "minimum order quantity"]),
        "order_multiple": ("number", False, ["order multiple", "krotność", "krotnosc"]),
        "safety_stock": ("number", False, ["safety stock", "zapas bezpieczeństwa"]),
    },
    "master": {
        "material": ("text", False, ["materiał", "material", "material name", "article", "item"]),
        "material_code": ("text", False, _CODE),
        "sku": ("text", False, ["sku"]),
        "unit": ("text", False, _UNIT),
        "supplier": ("text", False, _SUPPLIER),
        "lead_time_days": ("number", False, _LEAD),
        "minimum_order_quantity": ("number", False, ["moq", "minimum order quantity"]),
        "order_multiple": ("number", False, ["order multiple", "krotność", "krotnosc"]),
        "safety_stock": ("number", False, ["safety stock", "zapas bezpieczeństwa"]),
        "category": ("text", False, ["kategoria", "category", "group"]),
    },
}
IDENTITY_FIELDS = ["material_code", "sku", "material"]
ROLE_MATCH_THRESHOLD = 0.55
ROLE_THRESHOLDS = {"usage": 6.0, "stock": 5.0, "receipts": 6.0, "orders": 5.0, "master": 4.0}
ROLE_NAME_WORDS = {  # words in a table's name that speak for a role
    "usage": "zuzy|usage|consum|wykorzyst", "stock": "zapas|stock|inventory|stan",
    "receipts": "przyj|receipt|received|dostaw|inbound", "orders": "zamow|order|planowan|procurement",
    "master": "kartotek|master|slownik|indeks"}
ROLE_PRIMARY_WORDS = {  # a first table of these roles needs one of the words in its name
    "receipts": "przyj|receipt|received|dostaw|inbound", "orders": "zam[oó]w|order|planowan|procurement",
    "master": "kartotek|master|słownik|slownik|indeks|material"}

# ---- cleaning -------------------------------------------------------------------------
CLEANABLE_FIELDS = ["material", "brand", "line", "unit", "shift", "packaging_type", "category"]
UNIT_ALIASES = {
    "szt": "szt.", "szt.": "szt.", "pcs": "szt.", "pc": "szt.", "piece": "szt.", "pieces": "szt.",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg", "g": "g", "gram": "g", "grams": "g", "m": "m",
    "metr": "m", "meter": "m", "metre": "m", "cm": "cm", "mm": "mm", "l": "l", "ltr": "l", "liter": "l",
    "litre": "l", "ml": "ml", "rolka": "rolka", "roll": "rolka", "opakowanie": "opak.", "opak": "opak.",
    "opak.": "opak.", "karton": "karton", "box": "karton", "paleta": "paleta", "pallet": "paleta"}
SHIFT_ALIASES = {
    "1": "Zmiana 1", "01": "Zmiana 1", "zmiana 1": "Zmiana 1", "shift 1": "Zmiana 1",
    "2": "Zmiana 2", "02": "Zmiana 2", "zmiana 2": "Zmiana 2", "shift 2": "Zmiana 2",
    "3": "Zmiana 3", "03": "Zmiana 3", "zmiana 3": "Zmiana 3", "shift 3": "Zmiana 3",
    "rano": "Rano", "morning": "Rano", "popoludnie": "Popołudnie", "afternoon": "Popołudnie",
    "noc": "Noc", "night": "Noc"}
VALIDATION_MESSAGES = {
    "missing_date": "Brak daty.", "invalid_date": "Nieprawidłowa data.",
    "missing_material": "Brak nazwy materiału.", "missing_quantity": "Brak ilości.",
    "invalid_quantity": "Nieprawidłowa ilość.", "negative_quantity": "Ilość nie może być ujemna.",
    "zero_quantity": "Ilość wynosi zero.", "missing_brand": "Brak marki.",
    "missing_line": "Brak linii lub stanowiska.",
    "duplicate_record": "Wiersz powtarza identyczny rekord źródłowy lub ten sam unikalny identyfikator "
                        "operacji."}

# ---- planning -------------------------------------------------------------------------
MINIMUM_OBSERVED_DAYS, MEDIUM_OBSERVED_DAYS = 3, 7
LOW_DENSITY, MEDIUM_DENSITY = 0.1, 0.3
RISK_COVERAGE_DAYS = 7
ABC_A, ABC_B, PARETO_SHARE = 80, 95, 80
FORECAST_DAYS, FORECAST_BUFFER = 90, 0.15
UNIT_CONFLICT = "Niejednolite jednostki zużycia"
UNIT_MISMATCH = "Jednostka zapasu nie zgadza się z zużyciem"
UNKNOWN_MATERIAL = "Nieznany materiał"
MISSING = "(brak)"

# ---- header detection -----------------------------------------------------------------
HEADER_WORDS = (r"(?i)\b(article|artykul|material|product|brand|marka|qty|quantity|ilosc|amount|data|date|"
                r"order|ord|supplier|dostawc|category|kategor|status|numer|number|paleta|pallet|wz|"
                r"transport|recipient)\b")
TOTAL_WORDS = r"(?i)\b(suma|sum of|grand total|suma koncowa|razem|total)\b"
SUBTOTAL_CELL = r"(?i)^(suma|razem|total)$"

# ---- analysis rules -------------------------------------------------------------------
AGGREGATION_BY_ROLE = {"stock": "latest", "price": "average", "percentage": "average",
                       "duration": "average", "quantity": "sum", "currency": "sum", "cost": "sum",
                       "measure": "sum"}
MISSING_HIGH, MISSING_MEDIUM, DUPLICATE_HIGH, ALMOST_CONSTANT = 0.5, 0.1, 0.05, 0.98
TREND_STABLE, TREND_MEDIUM, TREND_HIGH, PERIOD_CHANGE = 0.03, 0.1, 0.25, 0.05
CORRELATION_SHOWN, CORRELATION_STRONG, CORRELATION_CHART = 0.35, 0.75, 0.25
MEASURE_ROLES = ["measure", "quantity", "currency", "percentage", "stock", "price", "cost", "duration"]
DIMENSION_ROLES = ["category", "material", "brand", "supplier", "status", "location", "person", "boolean"]
DELIVERY_DOMAINS = ["delivery_tracking", "procurement_plan", "hierarchical_delivery_plan",
                    "unloading_events"]

_AMOUNT, _NUMBER = ["number", "mixed"], ["number"]
#: (role, business role, priority, types or None, patterns, excluding patterns)
SEMANTIC_RULES = [
    ("date", "actual_delivery_date", 120, ["date"], ["data rozladunku", "unload.*date", "actual.*date"], []),
    ("date", "planned_delivery_date", 115, ["date"],
     ["delivery date", "on site date", "data dostaw", "termin dostaw"], []),
    ("date", "transport_date", 110, ["date"], ["transport date", "shipping date", "data transport"], []),
    ("date", "date", 60, ["date"],
     [r"\bdata\b", r"\bdate\b", "czas", "timestamp", "utworz", "created", "updated"], []),
    ("quantity", "remaining_pallet_count", 150, _AMOUNT, ["pozostal.*pall?et", "remaining.*pall?et"], []),
    ("quantity", "delivered_pallet_count", 145, _AMOUNT,
     ["rozladowan.*pall?et", "delivered.*pall?et", "unloaded.*pall?et"], []),
    ("quantity", "pallet_count", 135, _AMOUNT,
     ["amount.*plt", "ilosc.*palet", "liczba.*opakowan", "pallet.*count", r"\bplt\b"], []),
    ("quantity", "remaining_quantity", 145, _AMOUNT,
     ["pozostal.*qty", "remaining.*qty", "pozostal.*ilosc"], []),
    ("quantity", "ordered_quantity", 140, _AMOUNT,
     ["qty.*ordered", "ord qty", "ordered.*qty", "zamowion.*ilosc", "ilosc.*zamow"], []),
    ("quantity", "delivered_quantity", 120, _AMOUNT,
     ["delivered.*qty", "rozladowan.*qty", "^qty$", "ilosc dostarcz"], []),
    ("quantity", "usage_quantity", 115, _AMOUNT, ["zuzyc", "usage", "consumption"], []),
    ("quantity", "quantity", 75, _AMOUNT, ["ilosc", "quantity", "qty", "wolumen", "volume"], []),
    ("identifier", "order_id", 140, None,
     ["ord / req", "order number", "numer orderu", "nr zamow", "numer zamow"], []),
    ("identifier", "document_id", 135, None,
     ["numer wz", r"\bwz\b", "delivery note", "document number"], []),
    ("identifier", "product_code", 130, None,
     ["product number", "material code", "article number", "sku", "ean"], []),
    ("identifier", "contract_id", 125, None, ["contract number", "numer umow"], []),
    ("identifier", "account_id", 120, None, ["account number", "konto", "account code"], []),
    ("identifier", "record_id", 80, None, ["^id$", "identyfikator rekordu", "record id"], []),
    ("identifier", "identifier", 45, None,
     ["identyfik", r"\bnumer\b", r"\bnumber\b", r"\bnr\b", r"\bkod\b", r"\bcode\b"], []),
    ("category", "planning_category", 155, None, ["planning category", "kategoria planowania"], []),
    ("category", "language", 150, None, ["language code", "kod jezyk", "język"], []),
    ("location", "placement_code", 150, None,
     ["store placement code", "placement code", "kod lokalizacji"], []),
    ("supplier", "supplier", 170, None, ["^supplier", "dostawc", "vendor"], []),
    ("material", "material_name", 125, None,
     ["product name", "material", "artykul", "article", "item name", "nazwa.*towar"], []),
    ("brand", "brand", 110, None, ["marka", "brand", "client"], []),
    ("person", "owner", 105, None, ["responsible", "owner", "opiekun", "odpowiedzial"], []),
    ("location", "location", 70, None,
     ["lokac", "location", "magazyn", "warehouse", "site", "oddzial", "department", "dzial", "linia",
      "station", "stanowisko", "recipient"], []),
    ("category", "pallet_type", 110, None, ["^paleta$", "pallet type"], []),
    ("category", "size", 105, None, ["rozmiar", "size", "dimension"], []),
    ("category", "product_category", 90, None,
     ["product category", "kategor", "category", "typ", "type", "grupa", "group", "segment"], []),
    ("status", "status", 85, None, ["status", "stan procesu", "state", "result", "wynik"], []),
    ("stock", "stock", 100, _NUMBER, ["zapas", "stan", "stock", "inventory", "saldo", "on hand"], []),
    ("price", "unit_price", 100, _NUMBER, ["cena", "price", "unit cost", "koszt jednostk"], []),
    ("cost", "cost", 90, _NUMBER, ["koszt", "cost", "expense", "wydat"], []),
    ("currency", "currency_value", 65, _NUMBER,
     ["wartosc", "value", "kwota", "amount", "revenue", "przychod", "sprzedaz", "sales", "pln", "eur",
      "usd"], ["pallet", "palet", "plt", "qty", "ilosc"]),
    ("percentage", "percentage", 80, _NUMBER,
     ["procent", "percent", "udzial", "share", "rate", "ratio", "%"], []),
    ("duration", "duration", 80, _NUMBER,
     ["czas", "duration", "dni", "days", "godzin", "hours", "lead time"], []),
    ("free_text", "free_text", 55, None,
     ["opis", "description", "uwagi", "notes", "comment", "komentar", "adres"], []),
]
MEASURE_HINT = ("qty|quantity|ilosc|zuzyc|amount.*plt|pallet|palet|stock|zapas|cena|price|cost|koszt|"
                "wartosc|value|kwota|procent|percent")
IDENTIFIER_HINT = r"(^|\s)(id|kod|code|numer|number|nr|account)(\s|$)"
#: value pattern -> (business role, score)
VALUE_PATTERNS = [(r"(?i)^ORD[-\s/]", "order_id", 0.97), (r"(?i)^CON[-\s/]", "contract_id", 0.96),
                  (r"(?i)^(?:WZ[/-]|SN\d)", "document_id", 0.9)]
VALUE_STARTS = "ORD|CON|WZ|SN"
