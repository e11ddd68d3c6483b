"""A bounded table of values by word."""


class WordTable(dict):
    """Values made when first asked for; a full table starts anew, so it only saves time."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make = make
        self.limit = limit

    def __missing__(self, word):
        value = self.make(word)
        if len(word) < 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value
