"""The data model as Spark DDL schemas.

D3 is the hub: one wide result table in which ``test`` tells the suites apart
(missing keys are NULL). Timestamps are wall-clock (TIMESTAMP_NTZ)."""

# D1 + D2 + D4: one result row of any suite, with run identity
RESULTS = (
    "model string, run_ts timestamp_ntz, test string, context_length int, depth double, "
    "expected_tool string, instruction string, passkey string, answer string, answer_preview string, "
    "has_tool_call_tags boolean, valid_json boolean, correct_tool boolean, correct_arg_key boolean, "
    "correct_arg_value boolean, correct boolean, score int, elapsed double, output_tokens int, error string")
# D1/D2 as stored in result files (no run identity; it lives in the file name)
RESULT_FILE = (
    "test string, context_length int, depth double, expected_tool string, instruction string, "
    "passkey string, answer string, answer_preview string, has_tool_call_tags boolean, valid_json boolean, "
    "correct_tool boolean, correct_arg_key boolean, correct_arg_value boolean, correct boolean, score int, "
    "elapsed double, output_tokens int, error string")
# Messages, long form (preferred) and nested
MESSAGE = "conv_id long, turn long, role string, text string"
MESSAGES_NESTED = "conv_id long, messages array<struct<role: string, content: string>>"
# Test case (expectation)
CASE = "case_id string, instruction string, expected_tool string, expected_arg_key string, expected_arg_contains string"
# Tool definition
TOOL_DEFINITION = "name string, description string, parameters map<string, struct<type: string>>"
# Tool call (arguments kept as JSON text, then a string map)
TOOL_CALL = "name string, arguments string"
TOOL_CALL_MAP = "name string, arguments map<string, string>"
# Calibration sample
CALIB_SAMPLE = "sample long, input_ids array<long>, position_ids array<int>, beam_idx array<int>"
# Prompt manifest row
MANIFEST = ("sample long, file string, token_len int, num_exchanges int, final_request string, "
            "expected_tool_call struct<name: string, arguments: map<string,string>>, char_len long")
# Tensor catalog entry (shape kept as the XML string "128, 16, 128")
TENSOR = "id string, name string, element_type string, shape string, offset long, size long"
# Packed tensor block (uint4 pairs in bytes; scales as float, no float16 in Spark)
PACKED = "tensor string, block long, packed binary, scales array<float>, zero_points binary"
# Statistics target mapping
STAT_MAPPING = "saved_name string, original_name string, batch int"
# Throughput run
THROUGHPUT_RUN = "prompt string, response string, tokens int, throughput double, elapsed double"
# Chat reply
CHAT_REPLY = ("choices array<struct<message: struct<content: string>>>, "
              "usage struct<completion_tokens: bigint>")
