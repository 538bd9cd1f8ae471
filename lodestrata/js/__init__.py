"""Reading of JavaScript and TypeScript: parser, facts, lowering, data flow. Scanned code is parsed and never run."""
