"""Schemas of every record the pipeline reads or writes, as Spark DDL.

JSON payloads keep the snake_case names they carry on the wire.  Optional
fields are nullable; the required ones are listed separately so a decoder can
tell a missing value from a present one (see ``sources.codec.split_valid``).
Fields whose JSON type varies (array-or-string text, args given as a list or a
map, free-form objects) are declared ``variant`` and resolved by the helpers
in ``functions.json``.
"""

from __future__ import annotations

INTENT = "struct<confidence: double, intent: string>"
ENTITY = "struct<entity: string, location: array<string>, value: string>"
LAYOUT = "struct<name: string, index: string, disable_input: boolean>"
INPUT_VALIDATION = ("struct<oneOf: array<string>, someOf: array<string>, "
                    "range: array<decimal(38,18)>>")
FORM_FIELD = ("struct<name: string, label: string, required: boolean, "
              "validations: array<struct<regex: string, message: string>>>")
ACTION = "struct<name: string, args: variant>"
# A list of free-form objects: their values keep the JSON text.
FREE_FORM = "array<map<string, string>>"
LOG_DATA = (f"struct<entities: array<{ENTITY}>, intents: array<{INTENT}>, "
            "default_voyager_workspace: boolean, show_intent_link: boolean, "
            f"workspace_id: string, workspace_type: string, wva_top_intent: {INTENT}>")
OUTPUT = (f"struct<text: variant, layout: {LAYOUT}, inputvalidation: {INPUT_VALIDATION}, "
          f"log_data: {LOG_DATA}, log_messages: array<string>, node_position: string, "
          f"nodes_visited: array<string>, store: array<{FORM_FIELD}>, action: {ACTION}, "
          "variables: boolean>")
# dialog_stack items are objects {dialog_node}; an older message model also
# allows bare strings, so the items stay variant and are resolved on read.
SYSTEM_CONTEXT = ("struct<branch_exited: boolean, branch_exited_reason: string, "
                  "dialog_request_counter: int, dialog_stack: array<variant>, "
                  "dialog_turn_counter: int, dialog_in_progress: boolean, "
                  "_node_output_map: map<string, array<string>>>")
CONTEXT = (f"struct<conversation_id: string, system: {SYSTEM_CONTEXT}, "
           "request: struct<name: string>, location_type: string, user_location: string, "
           "user_id: string, lp_chat_id: string, browser: string, device: string, "
           "operating_system: string, channel: string, resolution_status: string, "
           "sentiment: string>")
BOT_MESSAGE = (f"struct<context: {CONTEXT}, data: {FREE_FORM}, "
               f"action: {ACTION}, entities: array<{ENTITY}>, "
               f"inputvalidation: {INPUT_VALIDATION}, intents: array<{INTENT}>, "
               f"layout: {LAYOUT}, log_data: {LOG_DATA}, node_position: string, "
               f"nodes_visited: array<string>, output: {OUTPUT}, text: array<string>>")
BOT_RESPONSE = f"struct<bot_id: string, dialog_id: string, message: {BOT_MESSAGE}>"

# {response, timestamp}: what the producer publishes on the bot-response topic.
RESPONSE_PAYLOAD = f"response {BOT_RESPONSE}, timestamp bigint"
# {bot_id, dialog_id, message{message?, userID?, context?}, timestamp}
REQUEST_PAYLOAD = ("bot_id string, dialog_id string, "
                   f"message struct<message: string, userID: string, context: {CONTEXT}>, "
                   "timestamp bigint")

USER = ("struct<id: string, firstName: string, lastName: string, picture: string, "
        "locale: string, timezone: int, gender: string>")
UTTERANCE = ("struct<messageType: string, sender: string, text: string, "
             "intent: struct<name: string, confidence: double>, "
             "entities: array<struct<name: string, value: string>>, "
             "timestamp: bigint, time: string>")
USER_MESSAGE = f"user {USER}, utterance {UTTERANCE}"
SYSTEM_TEXT_MESSAGE = ("messageType string, recipient string, text string, node string, "
                       "nodeType string, parent string, flow string, path array<string>, "
                       "timestamp bigint, time string")

# Required JSON paths per payload kind: a record missing any of them is a
# decode failure (optional fields may be absent).
REQUIRED_PATHS = {
    "response": [
        "response", "response.bot_id", "response.dialog_id", "response.message",
        "response.message.context", "response.message.context.conversation_id",
        "response.message.context.system",
        "response.message.context.system.dialog_request_counter",
        "response.message.context.system.dialog_stack",
        "response.message.context.system.dialog_turn_counter",
        "response.message.text", "timestamp",
    ],
    "request": ["bot_id", "dialog_id", "message", "timestamp"],
    "user_message": [
        "user", "user.id", "user.firstName", "user.lastName", "user.picture",
        "user.locale", "user.timezone", "user.gender", "utterance",
        "utterance.messageType", "utterance.sender", "utterance.text",
        "utterance.intent", "utterance.intent.name", "utterance.intent.confidence",
        "utterance.entities", "utterance.timestamp", "utterance.time",
    ],
    "system_text": ["messageType", "recipient", "text", "node", "flow", "path",
                    "timestamp", "time"],
}

# Parents that may be absent, and what each must hold if it is there; ``[]`` marks
# a list, whose items must each hold it.
_CONTEXT_PARENTS = [("request", ["name"])]
_LOG_DATA_PARENTS = [("entities[]", ["entity", "location", "value"]), ("intents[]", ["confidence", "intent"]),
                     ("wva_top_intent", ["confidence", "intent"])]
_OUTPUT_PARENTS = [("layout", ["name"]), ("action", ["name"]), ("store[]", ["name", "label"]),
                   ("store[].validations[]", ["regex", "message"]),
                   *[(f"log_data.{p}", c) for p, c in _LOG_DATA_PARENTS]]
_MESSAGE_PARENTS = [("intents[]", ["confidence", "intent"]), ("entities[]", ["entity", "location", "value"]),
                    ("action", ["name"]), ("layout", ["name"]),
                    *[(f"context.{p}", c) for p, c in _CONTEXT_PARENTS],
                    *[(f"log_data.{p}", c) for p, c in _LOG_DATA_PARENTS],
                    *[(f"output.{p}", c) for p, c in _OUTPUT_PARENTS]]
OPTIONAL_PARENTS = {
    "response": [(f"response.message.{p}", c) for p, c in _MESSAGE_PARENTS],
    "request": [("message.context", ["conversation_id", "system"]),
                ("message.context.system", ["dialog_request_counter", "dialog_stack", "dialog_turn_counter"]),
                *[(f"message.context.{p}", c) for p, c in _CONTEXT_PARENTS]],
    "user_message": [("utterance.entities[]", ["name", "value"])],
    "system_text": [],
}

# The flattened fact row: one per bot response.
MESSAGE_COLUMNS = [
    "bot_id", "dialog_id", "conversation_id", "dialog_node", "location_type",
    "user_location", "user_id", "lp_chat_id", "browser", "device",
    "operating_system", "channel", "resolution_status", "sentiment", "text",
    "intents", "entities", "timestamp",
]
MESSAGE = (
    "bot_id string, dialog_id string, conversation_id string, dialog_node string, "
    "location_type string, user_location string, user_id string, lp_chat_id string, "
    "browser string, device string, operating_system string, channel string, "
    "resolution_status string, sentiment string, text string, "
    "intents array<struct<name: string, confidence: double>>, "
    "entities array<struct<name: string, value: string>>, timestamp bigint"
)
# The seven columns the measures read.
MEASURE_COLUMNS = ["user_id", "conversation_id", "browser", "device",
                   "operating_system", "resolution_status", "timestamp"]
