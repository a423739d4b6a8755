"""Struct types of the tables that are read from files."""

RECORD = """
id string, task string, benchmark string, source string, source_role string, generator string,
trajectory_id string, step_index int, domain string, website string, url string, image string,
image_locator struct<dataset:string, revision:string, file:string, row_group:int, row_in_group:int,
row_index:bigint, kind:string, screenshot:string>,
question string, prompt string, answer string, question_type string, question_form string,
bbox_normalized array<double>, target_point_normalized array<double>, target_action string,
original_width int, original_height int, image_width int, image_height int, split string,
hostname string, website_surface string, website_category string,
website_category_confidence string, website_category_rule string, application_focused boolean,
prediction string, run_signature string, evaluation_label string, shard_index int, order_key bigint
"""

STEP = """
struct<screenshot:string, image_w:int, image_h:int,
other_obs:struct<page_index:int, open_pages_titles:array<string>, open_pages_urls:array<string>,
url:string>,
action:struct<action_output:struct<thought:string, action_name:string, action:string>>>
"""
TRAJECTORY = f"map<string, {STEP.strip()}>"
INSTRUCTION = "struct<goal:string, high_level:string, mid_level:string, low_level:string>"

EPISODE = """
episode_id string, variant_id string, policy_id string, reward_id string, task_id string,
instruction string, seed int, max_steps int, steps_taken int, success boolean,
total_reward double, parse_errors int,
steps array<struct<step_index:int, raw_policy_output:string, parse_error:string,
environment_error:string, reward_signals:map<string,double>, reward:double, done:boolean,
success:boolean>>
"""

PROGRESS = """
timestamp_utc string, event string, stage string, completed bigint, total bigint, percent double,
elapsed_seconds double, items_per_second double, eta_seconds double
"""

# One metrics tree, flattened: the table behind receipts, gates and reports.
METRIC = """
run_id string, control string, size string, seed int, step int, model string,
model_revision string, adapter_sha256 string, suite string, shard_index int, task string,
metric string, value double
"""
