"""Fixed values of the event contract.

These must equal the values the upstream trackers and order service emit; they are
data, not logic, so they are kept here together and in their natural order.
"""

# --- fixed values: accepted event types -------------------------------------------
EVENT_TYPES = (
    "page_view",
    "product_view",
    "add_to_cart",
    "remove_from_cart",
    "checkout_start",
    "purchase",
    "session_start",
    "order_cancel",
)

# Event types that represent a real browsing session (used by unique_sessions,
# session geo, referrers).
BROWSE_TYPES = ("page_view", "session_start")

# Event types that move order books.
ORDER_TYPES = ("purchase", "order_cancel")

# --- fixed values: envelope limits ------------------------------------------------
MAX_BODY_BYTES = 1 << 20
MAX_EVENTS_PER_BATCH = 100
MAX_EVENT_AGE_HOURS = 24

# --- fixed values: session cookie lifetime (0.02 day) -------------------------------
SESSION_GAP_SECONDS = 1728

# --- fixed values: tracking pixel types ----------------------------------------------
PIXEL_TYPES = ("vk", "yandex_metrika", "meta", "google_analytics", "custom")

# --- fixed values: funnel stages (name, label) ----------------------------------------
FUNNEL_STAGES = (
    ("visits", "Визиты"),
    ("product_views", "Просмотр товара"),
    ("add_to_cart", "Добавлено в корзину"),
    ("checkout_starts", "Готов к оплате"),
    ("purchases", "Оплаченные заказы"),
)

# Intraday bucket width in seconds (two hours).
INTRADAY_BUCKET_SECONDS = 7200
