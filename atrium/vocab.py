"""Vocabulary, rule thresholds and registries. All tables here are fixed values of the common plan format."""

# Canonical room types, in their defined order.
ROOM_TYPES = [
    "living_room", "kitchen", "bedroom", "bathroom", "balcony", "entrance", "dining_room", "study",
    "storage", "corridor", "garage", "laundry", "closet", "outdoor", "other",
]

# Normalised label -> canonical type.
ALIAS_TO_TYPE = {
    "living_room": "living_room", "livingroom": "living_room", "living": "living_room", "lounge": "living_room", "draw_room":
    "living_room", "drawing_room": "living_room", "family_room": "living_room", "livingroom_kitchen": "living_room",
    "kitchen": "kitchen", "kitchen_dining": "kitchen",
    "bedroom": "bedroom", "master_room": "bedroom", "masterroom": "bedroom", "second_room": "bedroom", "secondroom": "bedroom",
    "child_room": "bedroom", "childroom": "bedroom", "elder_room": "bedroom", "elderroom": "bedroom", "guest_room": "bedroom",
    "guestroom": "bedroom", "master_bedroom": "bedroom",
    "bathroom": "bathroom", "bath": "bathroom", "toilet": "bathroom", "wc": "bathroom", "restroom": "bathroom", "sauna":
    "bathroom",
    "balcony": "balcony", "terrace": "balcony", "loggia": "balcony",
    "entrance": "entrance", "entry": "entrance", "foyer": "entrance", "hall": "entrance",
    "dining_room": "dining_room", "diningroom": "dining_room", "dining": "dining_room",
    "study": "study", "studyroom": "study", "study_room": "study", "office": "study", "library": "study",
    "storage": "storage", "store_room": "storage", "storeroom": "storage", "utility": "storage", "technical_room": "storage",
    "corridor": "corridor", "hallway": "corridor", "passage": "corridor",
    "garage": "garage", "carport": "garage",
    "laundry": "laundry", "laundry_room": "laundry",
    "closet": "closet", "wardrobe": "closet", "walk_in_closet": "closet", "dressing_room": "closet",
    "outdoor": "outdoor", "garden": "outdoor", "yard": "outdoor", "patio": "outdoor",
    "other": "other", "undefined": "other", "unknown": "other", "room": "other",
}

# Minimum area (m2), minimum clear width (m), maximum aspect (None = unconstrained) per type.
THRESHOLDS = [
    ("living_room", 8.0, 2.4, 4.0), ("kitchen", 3.0, 1.5, 4.0), ("bedroom", 5.0, 2.0, 3.0),
    ("bathroom", 1.5, 1.0, 3.5), ("balcony", 1.0, 0.8, 10.0), ("entrance", 1.0, 0.9, 5.0),
    ("dining_room", 4.0, 2.0, 3.5), ("study", 4.0, 1.8, 3.0), ("storage", 0.5, 0.6, 6.0),
    ("corridor", 1.0, 0.8, None), ("garage", 10.0, 2.4, 4.0), ("laundry", 1.0, 0.9, 5.0),
    ("closet", 0.5, 0.6, 6.0), ("outdoor", 1.0, 0.8, None), ("other", 0.5, 0.6, None),
]

# Tolerances in metres.
WALL_HALF_M = 0.3
MIN_SHARED_WALL_M = 0.5
MIN_EDGE_M = 0.25
CORNER_TOL_M = 0.05

# Type groups.
STAT_GROUPS = {"entrance": "hallway", "corridor": "hallway"}
STAT_TYPES = ["living_room", "kitchen", "bedroom", "bathroom", "balcony", "hallway", "dining_room", "study",
              "storage", "garage", "laundry", "closet", "outdoor", "other"]
HABITABLE = ["living_room", "kitchen", "bedroom", "dining_room", "study"]
COUNTED_ROOMS = ["living_room", "bedroom", "study", "dining_room"]
NOT_DWELLING = ["balcony", "outdoor", "garage"]
APARTMENT_TYPES = ["living_room", "kitchen", "bedroom", "bathroom", "balcony", "hallway"]
HOUSE_MERGE = {"corridor": "hallway", "entrance": "hallway", "balcony": "outdoor", "closet": "storage"}

# Example rule pack (rule, subject, parameter, op, threshold, bindingness).
NORM_RULES = [
    ("door_width", "door", "door_clear_width", ">=", 0.80, "law"),
    ("corridor_width", "corridor", "width_m", ">=", 1.00, "law"),
    ("bedroom_area", "bedroom", "area_m2", ">=", 9.00, "model_code"),
    ("living_width", "living_room", "width_m", ">=", 3.20, "model_code"),
    ("dwelling_area", "dwelling", "area_m2", ">=", 30.0, "law"),
    ("bathroom_depth", "bathroom", "depth_m", ">=", 3.40, "guideline"),
]
BINDING = ["law", "model_code"]
