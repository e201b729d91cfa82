"""Fixed values that decide the results; every one is a default a caller may override."""

# Fixed values of the workload.
N_BLOCKS = 34
CLIP = (0.0, 20.0)
LAGS = (1, 2, 12)
EMA_SPANS = (4, 12, 26)
SIGNAL_SPAN = 9
TOP_K = 25
HEAD_ROWS = 5
DATE_PATTERN = "d.M.yyyy"
MISSING_LABEL = "nan"
DEDUP_KEYS = ("date", "date_block_num", "shop_id", "item_id", "item_cnt_day")
FOREST = {"trees": 25, "depth": 15, "seed": 42}
QUARTILES = (0.25, 0.5, 0.75)
