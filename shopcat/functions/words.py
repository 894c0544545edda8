"""Word lists and dictionaries of the Romanian book-shop domain.

They decide which markup is read as which field, so changing an entry changes results.
"""

TITLE_WORDS = ("titlu", "title", "nume", "name")
AUTHOR_WORDS = ("autor", "autori", "author", "authors")
PRICE_WORDS = ("pret", "price")
CODE_WORDS = ("isbn", "cod")
PUBLISHER_WORDS = ("publishing", "publisher", "editura")

FORMATS = {
    "hardcover": "hardcover",
    "paperback": "paperback",
    "pdf": "pdf",
    "epub": "epub",
    "mobi": "mobi",
    "audiobook": "audiobook",
    "audiobooks": "audiobook",
    "cartonata": "hardcover",
    "necartonata": "paperback",
}

# Keys are compared in lower case. "preoder" is spelled this way on purpose; "preorder" and
# "in stock" are not in the dictionary.
AVAILABILITY = {
    "indisponibil": "DISCONTINUED",
    "discontinued": "DISCONTINUED",
    "in stoc": "IN_STOCK",
    "în stoc": "IN_STOCK",
    "disponibil": "IN_STOCK",
    "in_stock": "IN_STOCK",
    "instock": "IN_STOCK",
    "limitat": "LIMITED_AVAILABILITY",
    "stoc limitat": "LIMITED_AVAILABILITY",
    "limited": "LIMITED_AVAILABILITY",
    "limited_availability": "LIMITED_AVAILABILITY",
    "limitedavailability": "LIMITED_AVAILABILITY",
    "epuizat": "OUT_OF_STOCK",
    "la comandă": "OUT_OF_STOCK",
    "la comanda": "OUT_OF_STOCK",
    "comandă": "OUT_OF_STOCK",
    "comanda": "OUT_OF_STOCK",
    "out_of_stock": "OUT_OF_STOCK",
    "outofstock": "OUT_OF_STOCK",
    "precomandă": "PREORDER",
    "precomanda": "PREORDER",
    "preoder": "PREORDER",
}

# The whole availability domain (schema.org ItemAvailability); five values are reachable from
# the dictionary above.
AVAILABILITY_VALUES = (
    "DISCONTINUED", "IN_STOCK", "IN_STORE_ONLY", "LIMITED_AVAILABILITY", "ONLINE_ONLY",
    "OUT_OF_STOCK", "PREORDER", "PRESALE", "SOLDOUT",
)

PRODUCT, JUNK, UNAVAILABLE, UNREACHABLE = "PRODUCT", "JUNK", "UNAVAILABLE", "UNREACHABLE"
ACTIVE, FINISHED, SCRAPE = "ACTIVE", "FINISHED", "SCRAPE"

# ISO 4217 code by ISO 3166 country.
CURRENCIES = {"RO": "RON", "MD": "MDL", "HU": "HUF", "BG": "BGN", "GB": "GBP", "US": "USD",
              "DE": "EUR", "FR": "EUR", "IT": "EUR", "ES": "EUR", "AT": "EUR"}

# Characters folded when keywords are split: from -> to, position by position.
DIACRITICS = ("ăâîșşțţáàäåãéèêëíìïóòôöõúùûüçñ", "aaissttaaaaaeeeeiiiooooouuuucn")
