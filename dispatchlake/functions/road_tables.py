"""Fixed values of the road-name rules: these must be as they are for names to come out right."""

#: Spellings of street suffixes and their canonical form. Fixed values.
SUFFIXES = {
    "STREET": "ST",
    "STR": "ST",
    "ST": "ST",
    "ROAD": "RD",
    "RD": "RD",
    "BOULEVARD": "BLVD",
    "BLVD": "BLVD",
    "BLV": "BLVD",
    "AVENUE": "AVE",
    "AVE": "AVE",
    "AV": "AVE",
    "PARKWAY": "PKWY",
    "PKWY": "PKWY",
    "PKY": "PKWY",
    "PW": "PKWY",
    "HIGHWAY": "HWY",
    "HWY": "HWY",
    "DRIVE": "DR",
    "DR": "DR",
    "LANE": "LN",
    "LN": "LN",
    "COURT": "CT",
    "CT": "CT",
    "PLACE": "PL",
    "PL": "PL",
    "CIRCLE": "CIR",
    "CIR": "CIR",
    "TRAIL": "TRL",
    "TRL": "TRL",
    "TERRACE": "TER",
    "TER": "TER",
    "ALLEY": "ALY",
    "ALY": "ALY",
    "EXPRESSWAY": "EXPY",
    "EXPY": "EXPY",
    "FREEWAY": "FWY",
    "FWY": "FWY",
    "THRUWAY": "THRUWAY",
    "THWY": "THRUWAY",
    "TRWY": "THRUWAY",
    "BYPASS": "BYP",
    "BYP": "BYP",
    "CROSSING": "XING",
    "XING": "XING",
    "EXTENSION": "EXT",
    "EXT": "EXT",
    "PLAZA": "PLZ",
    "PLZ": "PLZ",
    "SQUARE": "SQ",
    "SQ": "SQ",
    "POINT": "PT",
    "PT": "PT",
    "COVE": "CV",
    "CV": "CV",
    "BEND": "BND",
    "BND": "BND",
}
#: Spellings of directions and their canonical form. Fixed values.
DIRECTIONS = {
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "NORTHEAST": "NE",
    "NORTHWEST": "NW",
    "SOUTHEAST": "SE",
    "SOUTHWEST": "SW",
    "N": "N",
    "S": "S",
    "E": "E",
    "W": "W",
    "NE": "NE",
    "NW": "NW",
    "SE": "SE",
    "SW": "SW",
}
#: Directions of travel, which no name keeps. Fixed values.
TRAVEL = [
    "NB",
    "SB",
    "EB",
    "WB",
    "NBD",
    "SBD",
    "EBD",
    "WBD",
]
#: Words that begin a unit within an address. Fixed values.
UNITS = [
    "APT",
    "APTS",
    "APARTMENT",
    "APARTMENTS",
    "STE",
    "SUITE",
    "UNIT",
    "BLDG",
    "BUILDING",
    "LOT",
    "RM",
    "ROOM",
    "FL",
    "FLOOR",
    "TRLR",
    "TRAILER",
    "SPC",
    "SPACE",
]
#: Towns that may follow a road. Fixed values.
TOWNS = [
    "LAFAYETTE",
    "BROUSSARD",
    "YOUNGSVILLE",
    "SCOTT",
    "CARENCRO",
    "DUSON",
    "MILTON",
    "MAURICE",
]
#: Words for the state and the parish that may follow a road. Fixed values.
STATES = [
    "LA",
    "LOUISIANA",
    "USA",
    "PARISH",
    "LAF",
]
#: Names that stand for another one. Fixed values.
ALIASES = {
    "E BROUSSARD": "E BROUSSARD RD",
    "W BROUSSARD": "W BROUSSARD RD",
    "AMBASSADOR CAFFERY": "AMBASSADOR CAFFERY PKWY",
    "AMB CAFFERY": "AMBASSADOR CAFFERY PKWY",
    "AMB CAFFERY PKWY": "AMBASSADOR CAFFERY PKWY",
    "AMBASSADOR CAFFERY PW": "AMBASSADOR CAFFERY PKWY",
    "EVANGELINE": "EVANGELINE THRUWAY",
    "EVANGELINE THWY": "EVANGELINE THRUWAY",
    "NW EVANGELINE THRUWAY": "EVANGELINE THRUWAY",
    "SE EVANGELINE THRUWAY": "EVANGELINE THRUWAY",
    "SW EVANGELINE THRUWAY": "EVANGELINE THRUWAY",
    "NE EVANGELINE THRUWAY": "EVANGELINE THRUWAY",
    "JOHNSTON": "JOHNSTON ST",
    "KALISTE SALOOM": "KALISTE SALOOM RD",
    "PINHOOK": "PINHOOK RD",
    "E PINHOOK RD": "PINHOOK RD",
    "W PINHOOK RD": "PINHOOK RD",
    "CAMELLIA": "CAMELLIA BLVD",
    "VEROT SCHOOL": "VEROT SCHOOL RD",
    "UNIVERSITY": "UNIVERSITY AVE",
    "CONGRESS": "CONGRESS ST",
    "WILLOW": "WILLOW ST",
}
#: Arterials that count as primary. Fixed values.
ARTERIALS = [
    "AMBASSADOR CAFFERY",
    "EVANGELINE THRUWAY",
    "NW EVANGELINE",
    "JOHNSTON ST",
    "JOHNSTON STREET",
    "PINHOOK",
    "KALISTE SALOOM",
    "HUGH WALLIS",
    "UNIVERSITY AVE",
    "UNIVERSITY BLVD",
    "CONGRESS ST",
    "CAMERON ST",
    "BERTRAND DR",
    "VEROT SCHOOL",
    "PONT DES MOUTON",
    "WILLOW ST",
    "ERASTE LANDRY",
    "MUDD AVE",
    "CURRY ST",
    "OAK PARK BLVD",
    "RIDGE RD",
    "NORTH UNIVERSITY",
    "S COLLEGE RD",
    "N COLLEGE RD",
    "CAMELLIA BLVD",
    "DUHON RD",
    "YOUNGSVILLE HWY",
    "SURREY ST",
]
#: Wordings of numbered highways: prefix of the name, and a pattern with the number. Fixed values.
HIGHWAYS = [
    ("I-", r"^(?:I|INT|INTERSTATE)[\s.-]*(\d{1,3})$"),
    ("US ", r"^(?:US|U\.S\.)[\s.-]*(?:HWY[\s.-]*)?(\d{1,3})$"),
    ("LA ", r"^(?:LA|LA\.)[\s.-]*(?:HWY[\s.-]*)?(\d{1,4})$"),
]
#: Road classes and what tells them, in order. Fixed values; the arterials come between the second primary and secondary.
CLASSES = [
    ("motorway", r"\bI[-\s]?\d{1,3}\b|\bINTERSTATE\s+\d"),
    ("trunk", r"\bU\.?S\.?\s*(?:HWY\s*)?-?\s*\d{1,3}\b"),
    ("primary", r"\bLA\s*-?\s*\d{1,3}\b|\bHWY\s*-?\s*\d{1,3}\b"),
    ("primary", "|".join(ARTERIALS)),
    ("secondary", r"\b(?:BLVD|BOULEVARD|PKWY|PARKWAY|THRUWAY|EXPRESSWAY)\b"),
    ("residential", r"\b(?:ST|STREET|DR|DRIVE|AVE|AVENUE|CT|COURT|CIR|CIRCLE|LN|LANE|PL|PLACE|WAY|TRL|TRAIL|LOOP)\b"),
]
#: Separators of roads, house numbers and bare numbers. Fixed values.
SEPARATOR = r"\s+(?:AT|&+|/|@|NEAR|AND)\s+|\s*[&/]\s*"
HOUSE = r"^\s*\d+[A-Z]?(?:\s*-\s*\d+[A-Z]?)?\s+(?:(?:BLK|BLOCK)\s+(?:OF\s+)?)?"
NUMBER = r"^\d+[A-Z]?(\s*-\s*\d+[A-Z]?)?$"
