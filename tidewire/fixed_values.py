"""Names, patterns and limits that results depend on.

They define the analysis itself (which theme strings count, which limits apply,
which columns a table has), so they are stated here once, as plain text.
"""

# --- fixed values: theme patterns, matched as substrings of lower-cased themes
THEME_PATTERNS = {
    "is_climate": [
        "env_climatechange",
        "wb_567_climate_change",
        "ungp_climate_change_action",
        "wb_579_climate_change_mitigation",
        "wb_1854_methane",
        "wb_1841_short_lived_climate_pollutants",
        "carbon",
        "emission",
        "decarbon",
        "net_zero",
    ],
    "is_carbon": ["carbon", "emission", "decarbon", "net_zero"],
    "is_cleantech": [
        "renewable",
        "solar",
        "wind",
        "hydrogen",
        "carboncapture",
        "wb_525_renewable_energy",
        "wb_528_solar_energy",
    ],
    "is_energy": [
        "energy_transition",
        "fossil_fuel",
        "wb_539_oil_and_gas_policy_strategy_and_institutions",
        "oil",
        "gas",
        "energy",
    ],
    "is_policy": [
        "policy",
        "regulation",
        "carbon_tax",
        "emissions_trading",
        "cap_and_trade",
        "wb_539_oil_and_gas_policy_strategy_and_institutions",
    ],
}
EXCLUDED_THEME = "business_climate"
NEWS_START = "2016-03-30"
NEWS_END = "2024-12-31"

# --- fixed values: market panel
MARKET_START = "2015-01-01"
MARKET_END = "2025-12-31"
MARKET_TRAIN_END = "2022-12-31"
MODEL_SPLIT = "2022-01-01"
MODEL_TEST_END = "2024-12-31"
TAIL_QUANTILE = 0.10
VOLATILITY_WINDOWS = (5, 10, 22)
MEAN_WINDOWS = (5, 10)

# --- fixed values: article extraction and cleaning
MIN_EXTRACTED_CHARS = 300
MIN_CLEAN_CHARS = 200
MAX_CLEAN_CHARS = 20000
MIN_SCORED_CHARS = 101
LOW_ALPHA = 0.50
NOISY_SHARE = 0.01
MIN_LATIN = 0.85
NOISE_CHARS = "ï»¿"
BYTE_ORDER_MARK = "\ufeff"
BROKEN_BYTE_ORDER_MARK = "ï»¿"
DOWNLOAD_FAILED = "download_failed"
NAVIGATION_URL = "/authors?/|/tags?/|/categor|/search|/topics?/"
BLOCKED_DOMAINS = ("upstract.com",)
JUNK_WORDS = {"more": 8, "video": 8}
JUNK_MARKER = "#NAME?"
JUNK_SEPARATOR = " - "
MAX_SEPARATORS = 40

# --- fixed values: text that was decoded with the wrong code page, and its repair
# (the two dash entries end in a curly quote, written as an escape)
MOJIBAKE = {
    "â€™": "'",
    "â€œ": '"',
    "â€\u201d": "-",
    "â€\u201c": "-",
    "â€¦": "...",
    "â€": '"',
    "Â ": " ",
    "Â": "",
    "\ufeff": " ",
    "ï»¿": " ",
}

# --- fixed values: labels and score limits
LABEL_YES = "climate_yes"
LABEL_NO = "climate_no"
LABEL_CUT = 0.5
SURE_YES = 0.90
SURE_NO = 0.10

# --- fixed values: text features
MAX_TERMS = 10000
SCORER_BATCH = 32

# --- fixed values: column groups
TOPIC_FLAGS = [
    "is_core_climate",
    "is_policy_regulation",
    "is_physical_risk",
    "is_energy_geopolitics",
    "is_cleantech",
    "is_activism_litigation",
]
TOPIC_COUNTS = [
    "n_core_climate",
    "n_policy_regulation",
    "n_physical_risk",
    "n_energy_geopolitics",
    "n_cleantech",
    "n_activism_litigation",
]
WITHIN_SHARES = {
    "share_policy_within": "n_policy_regulation",
    "share_physical_within": "n_physical_risk",
    "share_energy_within": "n_energy_geopolitics",
    "share_cleantech_within": "n_cleantech",
    "share_activism_within": "n_activism_litigation",
}
FLAG_MEANS = {
    "frac_core_climate": "is_core_climate",
    "frac_policy": "is_policy_regulation",
    "frac_physical": "is_physical_risk",
    "frac_energy": "is_energy_geopolitics",
    "frac_cleantech": "is_cleantech",
    "frac_activism": "is_activism_litigation",
}
TEXT_SIGNAL = [
    "climate_prob_mean",
    "climate_prob_max",
    "climate_prob_std",
    "climate_share_bert",
    "log_n_articles",
]

# --- fixed values: feature sets of the tabular models
MARKET_FEATURES = [
    "lag1_return",
    "lag1_abs_return",
    "rvol_5d",
    "rvol_10d",
    "rvol_22d",
    "ret_mean_5d",
    "ret_mean_10d",
]
NEWS_WITHIN_FEATURES = [
    "log_n_articles_climate",
    "avg_tone",
    "avg_positivity",
    "avg_negativity",
    "narrative_entropy",
    "share_policy_within",
    "share_physical_within",
    "share_energy_within",
    "share_cleantech_within",
    "share_activism_within",
]
NEWS_GLOBAL_FEATURES = [
    "share_total_climate",
    "share_policy",
    "share_physical",
    "share_energy",
    "share_cleantech",
    "share_activism",
]
MODEL_CONFIGS = {
    "M1: Market-only": MARKET_FEATURES,
    "M2: Market+News(within)": MARKET_FEATURES + NEWS_WITHIN_FEATURES,
    "M3: Market+News(global)": MARKET_FEATURES + NEWS_GLOBAL_FEATURES,
    "M4: Market+News(all)": MARKET_FEATURES + NEWS_WITHIN_FEATURES + NEWS_GLOBAL_FEATURES,
    "M5: News-only(within)": NEWS_WITHIN_FEATURES,
    "M6: News-only(global)": NEWS_GLOBAL_FEATURES,
}
PREDICTORS = ["ret_lag1", "abs_ret_lag1", "rv_5", "rv_10", "rv_22", "ret_mean_5", "ret_mean_10", "ret_t_plus_1"]
MERGED_CONFIGS = {
    "market": MARKET_FEATURES,
    "market + news": MARKET_FEATURES + NEWS_GLOBAL_FEATURES,
    "market + news + text": MARKET_FEATURES + NEWS_GLOBAL_FEATURES + TEXT_SIGNAL,
}
LASSO_STRENGTHS = 20
LASSO_FOLDS = 5
MIN_COEFFICIENT = 0.001
SEQUENCE_WINDOWS = (10, 22)

# --- fixed values: table contracts
URL_SAMPLE_COLUMNS = [
    "year",
    "news_date",
    "event_timestamp",
    "url",
    "source",
    "tone_score",
    *TOPIC_FLAGS,
    "n_active_buckets",
    "priority_score",
]
ARTICLE_TEXT_COLUMNS = [
    "year",
    "news_date",
    "event_timestamp",
    "url",
    "url_norm",
    "domain",
    "source",
    "tone_score",
    *TOPIC_FLAGS,
    "n_active_buckets",
    "priority_score",
    "extract_success",
    "extract_method",
    "text_len",
    "text",
]
CLEAN_ARTICLE_COLUMNS = [
    "news_date",
    "first_timestamp_utc",
    "last_timestamp_utc",
    "url",
    "url_norm",
    "source",
    "domain",
    "extract_success",
    "extract_method",
    "text_len",
    "text_len_clean",
    "alpha_ratio",
    "latin_ratio",
    "weird_char_ratio",
    "quality_flag",
    "lang",
    "is_english",
    "text_clean",
    *TOPIC_FLAGS,
    "tone_score",
]
MARKET_PANEL_COLUMNS = [
    "day",
    "date",
    "wti_price",
    "price_valid_for_log",
    "log_price",
    "log_return",
    "ret_lag1",
    "abs_ret_lag1",
    "rv_5",
    "rv_10",
    "rv_22",
    "ret_mean_5",
    "ret_mean_10",
    "ret_t_plus_1",
    "target_tail_t_plus_1",
    "tail_threshold_train",
    "usable_for_model",
]
