"""A small labelled corpus of our own: three files, three queries, two relevant functions each."""

SOURCES = {
    "harbor/tides.ts": """/** Water levels at a pier, in centimetres. */
const LOW = 40;

export class TideTable {
  constructor(private readings: number[]) {}

  highest() {
    return this.readings.reduce(larger, LOW);
  }

  static parse(line: string) {
    return new TideTable(splitNumbers(line));
  }
}

const larger = (a: number, b: number) => (a > b ? a : b);
export function splitNumbers(line: string) {
  return line.split(" ").map(Number);
}
""",
    "orders/cart.ts": """class Cart {
  items = [];
  add(item) { this.items.push(item); this.recount(); }
  recount() { return cartTotal(this.items); }
}

export const cartTotal = (items) => items.reduce((sum, item) => sum + rebate(item), 0);
function rebate(item) { return item.price * 0.9; }
""",
    "mail.js": """export function sendInvite(address) {
  return deliver(address, "Welcome");
}

const deliver = (address, subject) => ({ address, subject });
module.exports.render = function (name) { return `Hello ${sendInvite(name)}`; };
""",
}
QUERIES = [(1, "highest water level of the tide table"), (2, "cart total with rebate"), (3, "send invite mail to address")]
QRELS = [
    (1, "harbor/tides.ts:highest"), (1, "harbor/tides.ts:splitNumbers"),
    (2, "orders/cart.ts:cartTotal"), (2, "orders/cart.ts:rebate"),
    (3, "mail.js:sendInvite"), (3, "mail.js:deliver"),
]
# (file, name, kind, class) in reading order.
FUNCTIONS = [
    ("harbor/tides.ts", "constructor", "method", "TideTable"), ("harbor/tides.ts", "highest", "method", "TideTable"),
    ("harbor/tides.ts", "parse", "method", "TideTable"), ("harbor/tides.ts", "larger", "arrow", None),
    ("harbor/tides.ts", "splitNumbers", "function", None),
    ("mail.js", "sendInvite", "function", None), ("mail.js", "deliver", "arrow", None),
    ("mail.js", "module.exports.render", "function", None),
    ("orders/cart.ts", "add", "method", "Cart"), ("orders/cart.ts", "recount", "method", "Cart"),
    ("orders/cart.ts", "cartTotal", "arrow", None), ("orders/cart.ts", "<anonymous>", "arrow", None),
    ("orders/cart.ts", "rebate", "function", None),
]
EDGES = {
    ("sendInvite", "deliver"), ("module.exports.render", "sendInvite"), ("add", "recount"), ("recount", "cartTotal"),
    ("cartTotal", "rebate"), ("<anonymous>", "rebate"), ("parse", "splitNumbers"),
}
