"""Names, word lists, patterns and thresholds that results depend on."""

# --- fixed values: detector classes and how they are analysed ---------------
CLASS_SPECS = (
    # (class, analyzer kind, signal subtype)
    ("traffic_light", "traffic_light", None),
    ("pedestrian_signal", "traffic_light", "PEDESTRIAN"),
    ("vehicle_traffic_light", "traffic_light", "VEHICLE"),
    ("bus", "bus", None),
    ("kiosk", "kiosk", None),
    ("self_service_kiosk", "kiosk", None),
    ("touchscreen_kiosk", "kiosk", None),
    ("sign", "text", None),
    ("stop_sign", "text", None),
    ("display", "text", None),
    ("screen", "text", None),
    ("monitor", "text", None),
    ("tv", "text", None),
    ("ticket_machine", "text", None),
    ("bus_route_display", "text", None),
    ("reverse_vending_machine", "generic", None),
    ("unknown", "generic", None),
    ("unknown_object", "generic", None),
    ("unknown_panel", "generic", None),
)
ANALYZER_NAMES = {
    "traffic_light": "TrafficLightAnalyzer",
    "bus": "BusAnalyzer",
    "kiosk": "KioskAnalyzer",
    "text": "TextObjectAnalyzer",
    "generic": "GenericVisionAnalyzer",
}
SIGNAL_TYPES = tuple(name for name, kind, _ in CLASS_SPECS if kind == "traffic_light")
KIOSK_TYPES = tuple(name for name, kind, _ in CLASS_SPECS if kind == "kiosk")
VEHICLE_TYPES = ("bus", "car", "vehicle")
LEGACY_SIGNAL_CLASS_ID = 9

# --- fixed values: object families used when scoring ------------------------
FAMILY_SIGNAL_TYPES = (*SIGNAL_TYPES, "signal", "vehicle_signal")
FAMILY_BUS_TYPES = ("bus",)
FAMILY_KIOSK_TYPES = (
    "kiosk",
    "screen",
    "display",
    "monitor",
    "tv",
    "ticket_machine",
    "reverse_vending_machine",
    "unknown_panel",
)
FAMILY_KIOSK_WORDS = ("kiosk", "screen", "display", "machine", "panel")
CATEGORY_SIGNAL_WORDS = ("signal", "traffic_light")
CATEGORY_BUS_WORDS = ("bus",)
CATEGORY_KIOSK_WORDS = ("kiosk", "screen", "machine", "display")

# --- fixed values: states ----------------------------------------------------
UNKNOWN_STATES = ("", "UNKNOWN", "UNCERTAIN", "NONE")
SIGNAL_STATES = ("RED", "GREEN", "YELLOW", "UNKNOWN")
SCORED_SIGNAL_STATES = ("RED", "GREEN", "YELLOW")
LABELLED_SIGNAL_STATES = ("RED", "GREEN", "YELLOW", "OFF")
ANNOTATED_SIGNAL_STATES = ("RED", "GREEN", "YELLOW", "OFF", "UNKNOWN")
MOTION_STATES = ("APPROACHING", "STOPPED", "RECEDING", "UNKNOWN")
SCREEN_STAGES = ("ORDER_TYPE_SELECTION", "PAYMENT", "CONFIRMATION", "UNKNOWN")
REVIEW_STATUSES = ("needs_manual_review", "reviewed")
SUCCESSFUL_RUNS = ("success", "ok", "completed")

# --- fixed values: event types ----------------------------------------------
LEGACY_EVENT_TYPES = {
    "appeared": "OBJECT_APPEARED",
    "disappeared": "OBJECT_DISAPPEARED",
    "signal_changed": "OBJECT_STATE_CHANGED",
}

# --- fixed values: collision risk ---------------------------------------------
MOVING_HAZARD_TYPES = (
    "person",
    "bicycle",
    "motorcycle",
    "scooter",
    "car",
    "vehicle",
    "bus",
    "truck",
    "carrier",
    "stroller",
    "wheelchair",
)

# --- fixed values: kiosk wording -----------------------------------------------
DINE_IN_PHRASES = ("매장 식사", "매장에서", "먹고 가기", "eat in", "dine in")
TAKEOUT_PHRASES = ("포장", "가져가기", "take out", "takeout", "to go")
PAYMENT_STRONG_PHRASES = (
    "결제 방법",
    "결제 수단",
    "결제하기",
    "카드를 넣어",
    "카드를 삽입",
    "payment method",
    "select payment",
    "insert card",
    "pay now",
)
PAYMENT_ACTION_PHRASES = ("결제", "payment", "pay")
PAYMENT_METHOD_PHRASES = ("카드", "현금", "간편 결제", "card", "cash")
CONFIRMATION_PHRASES = (
    "주문 완료",
    "주문이 완료",
    "결제 완료",
    "결제가 완료",
    "주문하시겠습니까",
    "결제하시겠습니까",
    "order complete",
    "order confirmed",
    "payment complete",
    "confirm order",
)
OPTION_PHRASES = (*DINE_IN_PHRASES, *TAKEOUT_PHRASES, *PAYMENT_METHOD_PHRASES)
EXACT_OPTIONS = (
    "확인",
    "취소",
    "이전",
    "다음",
    "주문하기",
    "결제하기",
    "confirm",
    "cancel",
    "back",
    "next",
    "order",
    "pay now",
)

# --- fixed values: route numbers on vehicles ------------------------------------
ROUTE_PATTERN = (
    r"(?<![A-Z0-9])(?:[A-Z]{1,2}\d{1,5}(?:-\d{1,2})?|\d{1,5}(?:-\d{1,2})?)(?![A-Z0-9])"
)
UNREADABLE_MARKS = ("?", "*", "�")
ROUTE_ROI = (0.08, 0.0, 0.92, 0.55)

# --- fixed values: messages -------------------------------------------------------
STATE_LABELS = {"GREEN": "초록색", "RED": "빨간색", "YELLOW": "노란색"}
OBJECT_LABELS = {
    "pedestrian_signal": "보행자 신호",
    "vehicle_traffic_light": "차량 신호",
    "traffic_light": "신호등",
    "bus": "버스",
    "kiosk": "키오스크",
    "self_service_kiosk": "무인 키오스크",
    "touchscreen_kiosk": "터치스크린 키오스크",
    "sign": "표지판",
    "stop_sign": "표지판",
    "display": "전광판",
    "screen": "화면",
    "monitor": "화면",
    "tv": "화면",
    "ticket_machine": "발권기",
    "reverse_vending_machine": "빈 용기 회수기",
    "bus_route_display": "버스 노선 표시기",
    "unknown_panel": "알 수 없는 조작 패널",
    "person": "사람",
    "car": "자동차",
    "vehicle": "차량",
    "bicycle": "자전거",
    "motorcycle": "오토바이",
    "scooter": "킥보드",
    "truck": "트럭",
    "traffic_sign": "표지판",
    "bench": "벤치",
    "chair": "의자",
    "table": "탁자",
    "potted_plant": "화분",
    "fire_hydrant": "소화전",
    "pole": "기둥",
    "tree_trunk": "가로수",
    "bollard": "볼라드",
    "barricade": "바리케이드",
    "movable_signage": "입간판",
    "carrier": "손수레",
    "stroller": "유모차",
    "wheelchair": "휠체어",
    "parking_meter": "주차 요금기",
}
ZONE_LABELS = {"LEFT": "왼쪽에서", "CENTER": "정면에서", "RIGHT": "오른쪽에서"}
BUS_APPROACH_SENTENCE = "버스가 접근하고 있습니다."
BUS_ARRIVAL_SUFFIX = "버스가 들어오고 있습니다."
PEDESTRIAN_SIGNAL_WORDS = "보행자 신호"
PAYMENT_NARRATION_WORDS = ("payment", "confirmation", "결제", "확인")

# --- fixed values: places and distances in the latest frame -----------------------
POSITION_LEFT, POSITION_CENTER, POSITION_RIGHT = "왼쪽", "중앙", "오른쪽"
POSITION_FULL = "전방 전체"
DISTANCE_NEAR, DISTANCE_MID, DISTANCE_FAR = "가까움", "중간", "멀리"
IMPORTANT_VEHICLES = ("bus", "car", "truck", "van", "motorcycle", "train", "scooter")
IMPORTANT_LIVING = ("person", "bicycle", "wheelchair", "stroller", "dog")
IMPORTANT_WORDS = ("kiosk", "sign", "screen", "panel", "text", "door", "stairs")
OBJECT_NAME_ALIASES = {
    "사람": "person",
    "버스": "bus",
    "자동차": "car",
    "차": "car",
    "트럭": "truck",
    "자전거": "bicycle",
    "오토바이": "motorcycle",
    "신호등": "traffic_light",
    "보행자신호": "pedestrian_signal",
    "표지판": "traffic_sign",
    "볼라드": "bollard",
    "나무": "tree_trunk",
    "가로수": "tree_trunk",
    "기둥": "pole",
    "전봇대": "pole",
    "의자": "chair",
    "벤치": "bench",
    "키오스크": "kiosk",
    "휠체어": "wheelchair",
    "유모차": "stroller",
    "소화전": "fire_hydrant",
    "입간판": "movable_signage",
    "간판": "movable_signage",
    "킥보드": "scooter",
    "스쿠터": "scooter",
}

# --- fixed values: kinds of questions and when an image is needed ------------------
QUESTION_WORDS = (
    ("crossing", ("건너", "횡단")),
    (
        "can_i_go",
        (
            "가도 돼",
            "가도돼",
            "가도 될",
            "가도될",
            "지나가도",
            "걸어가도",
            "출발해도",
            "이동해도",
            "앞으로 가",
        ),
    ),
    ("read_text", ("써있", "써 있", "쓰여", "적혀", "뭐라고", "뭐라", "글자", "글씨", "읽어")),
    ("find_object", ("어디", "찾아")),
    ("describe", ("보여", "보이", "설명", "묘사", "장면", "상황", "주변에 뭐")),
)
DETAIL_WORDS = ("자세히", "상세", "구체적", "묘사")
VISION_WORDS = (
    "색",
    "글자",
    "글씨",
    "뭐라",
    "적혀",
    "써 있",
    "써있",
    "쓰여",
    "읽어",
    "그림",
    "모양",
    "생겼",
    "모습",
    "입은",
    "입고",
    "표정",
)

# --- fixed values: annotation files --------------------------------------------------
ANNOTATION_VERSION = "1.0"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
MASK_DIR_NAMES = ("mask", "masks")

# --- fixed values: categories of the batch runner ---------------------------------------
CATEGORY_CLASS_IDS = {
    "traffic_light": (9,),
    "bus": (5,),
    "kiosk_like_machine": None,
    "ticket_machine_screen": None,
}
REQUIRED_CLASSES = {
    "kiosk_like_machine": ("reverse_vending_machine",),
    "ticket_machine_screen": ("ticket_machine",),
}

# --- fixed values: names of the evaluation metrics -----------------------------------
METRICS = (
    "processed_frame_count",
    "effective_fps",
    "realtime_factor",
    "average_yolo_inference_ms",
    "detection_frame_ratio",
    "stable_id_fragmentation_count",
    "event_count",
    "duplicate_event_count",
    "generated_narrations",
    "uncertain_unknown_ratio",
    "signal_state_frame_accuracy",
    "signal_state_accuracy_by_state",
    "signal_confusion_matrix",
    "transition_precision",
    "transition_recall",
    "transition_delay_frames",
    "transition_delay_ms",
    "transition_delay_details",
    "false_green_confirmation_count",
    "duplicate_transition_count",
    "unconfirmed_pedestrian_signal_narration_count",
    "bus_detection_frame_ratio",
    "bus_track_fragmentation_count",
    "bus_approaching_precision",
    "bus_approaching_recall",
    "duplicate_bus_approach_event_count",
    "route_number_exact_match",
    "wrong_confirmed_route_number_count",
    "route_number_confirmation_delay_frames",
    "route_number_confirmation_delay_ms",
    "routed_analyzer_types",
    "screen_stage_accuracy",
    "ocr_exact_match",
    "ocr_normalized_edit_distance",
    "screen_change_precision",
    "screen_change_recall",
    "reverse_vending_as_order_kiosk_count",
    "defective_screen_false_stage_count",
)
PERFORMANCE_METRICS = (
    "processed_frame_count",
    "effective_fps",
    "realtime_factor",
    "average_yolo_inference_ms",
    "detection_frame_ratio",
    "event_count",
    "duplicate_event_count",
    "generated_narrations",
    "uncertain_unknown_ratio",
    "routed_analyzer_types",
)
